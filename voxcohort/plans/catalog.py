"""All contract queries, gathered from the query modules."""

from voxcohort.plans import cohort_queries, model_queries, scoring_queries, texture_queries, views, voxel_queries  # noqa: F401
from voxcohort.plans.registry import ORACLES, QUERIES  # noqa: F401
