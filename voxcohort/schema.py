"""Explicit schemas at the table boundaries."""

from pyspark.sql import types as T


def _struct(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


VOLUMES = _struct(
    ("case_id", T.LongType()), ("nx", T.IntegerType()), ("ny", T.IntegerType()), ("nz", T.IntegerType()),
    ("sx", T.DoubleType()), ("sy", T.DoubleType()), ("sz", T.DoubleType()),
    ("ox", T.DoubleType()), ("oy", T.DoubleType()), ("oz", T.DoubleType()),
    ("dir", T.ArrayType(T.DoubleType())),
)
VOXELS = _struct(
    ("case_id", T.LongType()), ("z", T.IntegerType()), ("y", T.IntegerType()), ("x", T.IntegerType()),
    ("label", T.IntegerType()), ("pet", T.DoubleType()), ("ct", T.DoubleType()),
)
CLINICAL_RECORD = _struct(
    ("CenterID", T.IntegerType()), ("Age", T.IntegerType()), ("Gender", T.IntegerType()),
    ("Tobacco Consumption", T.IntegerType()), ("Alcohol Consumption", T.IntegerType()),
    ("Performance Status", T.IntegerType()), ("Treatment", T.IntegerType()), ("HPV Status", T.IntegerType()),
)
SPLITS = _struct(
    ("folds", T.ArrayType(_struct(
        ("fold", T.IntegerType()), ("train", T.ArrayType(T.StringType())),
        ("val", T.ArrayType(T.StringType())), ("validation", T.ArrayType(T.StringType())),
    ))),
)
STAGING_CONFIG = _struct(
    ("N_rule", _struct(("N3_MM", T.DoubleType()), ("N1_MAX_MM", T.DoubleType()),
                       ("MIDLINE_DEADZONE_MM", T.DoubleType()))),
    ("T_features", T.ArrayType(T.StringType())),
    ("T_encoders", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    ("T_clinical_source", T.MapType(T.StringType(), T.StringType())),
    ("T_classes", T.ArrayType(T.StringType())),
    ("cv_scores", T.MapType(T.StringType(), T.DoubleType())),
)
# fixed values: output columns, in order
DISSEMINATION = [
    "case_id", "has_lesion", "Dmax_mm", "spread_mean_mm", "body_len_mm", "Dmax_norm", "n_lesions",
    "frac_largest", "total_lesion_ml", "centroid_spread_mm", "centroid_max_mm", "dist_p_to_n_max_mm",
    "dist_p_to_n_mean_mm", "gtvn_to_gtvp_ratio", "suv_max_all", "suv_mean_all", "suv_hetero", "suv_std_all",
]
