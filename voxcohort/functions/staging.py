"""Stage rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values of the shipped configuration
N3_MM = 55.0
N1_MAX_MM = 35.0
N_ORDINAL = {"N0": 0, "N1": 1, "N2": 2, "N3": 3}


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(c)


def rule_n(n, max_mm, laterality, n3=N3_MM, n1=N1_MAX_MM) -> Column:
    """N stage from node count, largest node and laterality; NULLs fall to N2."""
    n, max_mm, lat, n3, n1 = (_col(c) for c in (n, max_mm, laterality, n3, n1))
    return (F.when(n == 0, "N0").when(max_mm > n3, "N3")
            .when((n == 1) & lat.isin("unilateral", "midline") & (max_mm <= n1), "N1").otherwise("N2"))


def hpv_rule_n(n, max_mm, laterality, hpv, n3=60.0, n1=N1_MAX_MM) -> Column:
    """HPV-conditioned N stage: count-independent when HPV is positive."""
    hpv = _col(hpv)
    positive = (F.when(_col(n) == 0, "N0").when(_col(max_mm) > n3, "N3")
                .when(_col(laterality) == "bilateral", "N2").otherwise("N1"))
    return F.when(hpv.eqNullSafe(F.lit(1)), positive).otherwise(rule_n(n, max_mm, laterality))


def n_ordinal(stage) -> Column:
    pairs = [F.lit(v) for kv in N_ORDINAL.items() for v in kv]
    return F.element_at(F.create_map(*pairs), F.upper(F.substring(_col(stage), 1, 2)))


def with_t_prefix(stage) -> Column:
    stage = _col(stage)
    return F.when(F.upper(stage).startswith("T"), stage).otherwise(F.concat(F.lit("T"), stage))
