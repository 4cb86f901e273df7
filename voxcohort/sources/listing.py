"""Case discovery from file listings.

Listings are DataFrames with a ``path`` column; :func:`list_files` makes one from
a folder without reading file contents.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# fixed values: PET file names in order of preference ({id} is the folder's name)
PET_GLOBS = ["*{id}*PT*.nii.gz", "*__PT.nii.gz", "*_PT.nii.gz", "*PT.nii.gz", "*{id}*PET*.nii.gz", "*PET.nii.gz"]
LABEL_EXCLUDED = r"(?i)__?(CT|PT|PET)\.nii\.gz$"
CHANNELS = {"0": "CT", "1": "PET"}
LABELS = {"background": 0, "GTVp": 1, "GTVn": 2}


def list_files(spark: SparkSession, root: str, pattern: str = "*.nii.gz") -> DataFrame:
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
            .load(root).select("path", "length"))


def _parts(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").endswith(".nii.gz")).select(
        "path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("case"),
        F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("dir"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))


def fits_glob(name: Column, glob: str, case: Column) -> Column:
    """Whether a file name fits a glob in which {id} stands for the case."""
    texts = ["".join(".*" if c == "*" else re.escape(c) for c in part) for part in glob.split("{id}")]
    pieces = [F.lit(texts[0])]
    for text in texts[1:]:
        pieces += [F.lit("\\Q"), case, F.lit("\\E" + text)]
    return F.rlike(name, F.concat(F.lit("^"), *pieces, F.lit("$")))


def pet_priority(name: Column, case: Column) -> Column:
    """Position of the first PET glob a name fits; NULL when none does."""
    return F.coalesce(*[F.when(fits_glob(name, glob, case), i) for i, glob in enumerate(PET_GLOBS)])


def find_cases(files: DataFrame, pet: bool = True) -> DataFrame:
    """Complete cases (case, ct, pet, label), one per CT file with every role in its folder.

    CT is the ``__CT`` file where any folder has one, else any CT name; PET follows
    the ordered globs; the label is the first remaining volume.
    """
    f = _parts(files)
    strict = F.col("name").endswith("__CT.nii.gz")
    any_strict = f.agg(F.coalesce(F.bool_or(strict), F.lit(False)).alias("s")).scalar()
    is_ct = F.when(any_strict, strict).otherwise(F.col("name").endswith("CT.nii.gz"))
    rank = pet_priority(F.col("name"), F.col("case"))
    label = ~F.col("name").rlike(LABEL_EXCLUDED)
    folders = f.groupBy("dir", "case").agg(
        F.collect_list(F.when(is_ct, F.col("path"))).alias("cts"),
        F.min(F.when(rank.isNotNull(), F.struct(rank.alias("r"), F.col("path").alias("path")))).alias("p"),
        F.min(F.when(label, F.col("path"))).alias("label"))
    roles = ["ct", "label"] + (["pet"] if pet else [])
    return folders.select("case", F.explode("cts").alias("ct"), F.col("p.path").alias("pet"), "label").dropna(subset=roles).select("case", *roles)


def file_index(files: DataFrame) -> DataFrame:
    """(case, ct, pet) by case-insensitive suffix; the last path in order wins."""
    f = _parts(files)
    ct = F.col("name").rlike(r"(?i)CT\.nii\.gz$")
    pet = ~ct & F.col("name").rlike(r"(?i)(PT|PET)\.nii\.gz$")
    return f.where(ct | pet).groupBy("case").agg(
        F.max(F.when(ct, F.col("path"))).alias("ct"), F.max(F.when(pet, F.col("path"))).alias("pet"))


def fold_masks(files: DataFrame) -> DataFrame:
    """Out-of-fold masks: patient and fold from the path."""
    pattern = r"fold_(\d+)/validation/([^/]+)\.nii\.gz$"
    return files.where(F.col("path").rlike(pattern)).select(
        F.regexp_extract("path", pattern, 2).alias("PatientID"),
        F.regexp_extract("path", pattern, 1).cast("int").alias("fold"), "path")


def first_cases(cases: DataFrame, n: int, on: str = "case") -> DataFrame:
    return cases.orderBy(on).limit(n) if n > 0 else cases


def training_manifest(cases: DataFrame) -> DataFrame:
    """One row per artefact of a case: two image channels and the label."""
    item = lambda kind, path, suffix: F.struct(
        F.lit(kind).alias("channel"), F.col(path).alias("source"),
        F.concat("case", F.lit(suffix)).alias("target"))
    return cases.select("case", F.explode(F.array(
        item("CT", "ct", "_0000.nii.gz"), item("PET", "pet", "_0001.nii.gz"), item("label", "label", ".nii.gz"))).alias("i")
    ).select("case", "i.*")


def dataset_description(cases: DataFrame) -> DataFrame:
    """One row describing the training set: channels, labels, size, file ending."""
    as_map = lambda d: F.create_map(*[F.lit(v) for kv in d.items() for v in kv])
    return cases.agg(F.count("*").alias("numTraining")).select(
        as_map(CHANNELS).alias("channel_names"), as_map(LABELS).alias("labels"), "numTraining",
        F.lit(".nii.gz").alias("file_ending"))
