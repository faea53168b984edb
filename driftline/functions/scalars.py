"""Scalar functions of scores, and the few that Spark lacks as Arrow-batched pandas UDFs."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from driftline.functions.windows import clip


def logit(p) -> Column:
    p = clip(p, 1e-7, 1 - 1e-7)
    return F.log(p / (1 - p))


def expit(x) -> Column:
    return 1 / (1 + F.exp(-x))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


@pandas_udf(DoubleType())
def erf(x: pd.Series) -> pd.Series:
    return x.map(math.erf)


#: Lanczos' approximation of the gamma function (g = 7, nine terms).
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def lgamma(x) -> Column:
    """Log of the gamma function of x >= 0.5, to about 1e-14, by Lanczos' approximation."""
    y = F.col(x) - 1 if isinstance(x, str) else x - 1
    total = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        total = total + c / (y + k)
    t = y + 7.5
    return 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.log(t) - t + F.log(total)


#: Wichura's rational approximation of the normal quantile (AS 241, 16 digits); numerators and denominators
#: from the lowest power up, for the middle, the near and the far tail.
WICHURA = (
    ((3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
     (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)),
    ((1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
     (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)),
    ((6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
     (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)),
)


def _ratio(which: int, r: Column) -> Column:
    def poly(cs):
        out = F.lit(cs[-1])
        for c in cs[-2::-1]:
            out = out * r + c
        return out

    top, bottom = WICHURA[which]
    return poly(top) / poly(bottom)


def normal_quantile(p) -> Column:
    """Inverse of the normal distribution function, p kept within [1e-12, 1 - 1e-12]."""
    p = clip(p, 1e-12, 1 - 1e-12)
    q = p - 0.5
    far = F.sqrt(-F.log(F.least(p, 1 - p)))
    tail = F.when(far <= 5, _ratio(1, far - 1.6)).otherwise(_ratio(2, far - 5.0))
    return F.when(F.abs(q) <= 0.425, q * _ratio(0, 0.180625 - q * q)).otherwise(F.signum(q) * tail)


def gelu(x) -> Column:
    return x * 0.5 * (1 + erf(x / math.sqrt(2)))
