"""Join forms shared by the operators.

``preserving_left_join(dim, fact, key)`` is ``dim LEFT JOIN fact USING
(key)`` written so that a hot key in the fact cannot pin one task:

  * matched rows come from ``fact INNER JOIN dim`` - for an inner join AQE
    may split a skewed partition on either side (or broadcast the side
    whose measured size allows it);
  * unmatched dimension rows come from ``dim LEFT ANTI JOIN`` the fact's
    *distinct* keys - a partial aggregation, one row per key - so the anti
    join is never skewed either.

In the plain form the fact is the right side of a LEFT OUTER join, the side
AQE's skew handling cannot split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def preserving_left_join(dim: DataFrame, fact: DataFrame, key: str) -> DataFrame:
    matched = fact.join(dim, key, "inner")
    fact_keys = fact.select(key).where(F.col(key).isNotNull()).distinct()
    unmatched = dim.join(fact_keys, key, "left_anti")
    ordered = [key] + [c for c in dim.columns if c != key] + [c for c in fact.columns if c != key]
    return matched.select(*ordered).unionByName(unmatched, allowMissingColumns=True)
