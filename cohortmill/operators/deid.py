"""De-identification of record tags held as rows (file_id, depth, grp, elem, vr, val)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill.functions.hashing import decimal_of_hex, hmac_sha256

# Fixed values: (group, element) of the tags that name a person, an institution or hold free comments.
REMOVED = [
    (0x0010, 0x0010), (0x0010, 0x0020), (0x0010, 0x0030), (0x0010, 0x0040), (0x0010, 0x1010), (0x0010, 0x1020), (0x0010, 0x1030), (0x0010, 0x21B0), (0x0010, 0x4000),
    (0x0008, 0x0080), (0x0008, 0x0081), (0x0008, 0x1040), (0x0008, 0x0090), (0x0008, 0x1048), (0x0008, 0x1050), (0x0008, 0x1070),
    (0x0008, 0x0050), (0x0020, 0x0010), (0x0040, 0xA124), (0x0032, 0x4000), (0x0040, 0x0006), (0x0040, 0x1004),
]
# Tags whose identifiers are made anew.
UIDS = [(0x0020, 0x000D), (0x0020, 0x000E), (0x0008, 0x0018), (0x0008, 0x1195)]
# Text representations that are scanned, and the two patterns of personal data.
TEXT_VRS = ["LO", "LT", "SH", "ST", "PN", "UT"]
PII = [("iso_date", r"\b\d{4}-\d{2}-\d{2}\b"), ("name_pair", r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b")]
# What identity is replaced by, besides the pseudonym as patient id; a site may set its own marks.
IDENTITY = [(0x0010, 0x0010, "PN", "ANON^ANONYMIZED"), (0x0012, 0x0063, "LO", "PS3.15-BasicProfile"), (0x0012, 0x0062, "CS", "YES")]


def tag_in(tags: list[tuple[int, int]]) -> Column:
    """Whether (grp, elem) is one of a short fixed list."""
    return (F.col("grp") * 65536 + F.col("elem")).isin([g * 65536 + e for g, e in tags])


def twin_id(col: Column, seed: str) -> Column:
    """The pseudonym: a keyed hash, 64 hex digits."""
    return hmac_sha256(col, seed)


def patient_keys(tags: DataFrame, content_sha: Column) -> DataFrame:
    """(file_id, patient_key, missing): the trimmed patient id, or the content hash where blank or absent."""
    pid = F.max(F.when((F.col("depth") == 0) & tag_in([(0x0010, 0x0020)]), F.trim("val")))
    rows = tags.groupBy("file_id").agg(pid.alias("__pid"), F.first(content_sha).alias("__sha"))
    key = F.nullif(F.col("__pid"), F.lit(""))
    return rows.select("file_id", F.coalesce(key, "__sha").alias("patient_key"), key.isNull().alias("missing"))


def removable() -> Column:
    """Listed tags and private ones, whose group is odd."""
    return tag_in(REMOVED) | (F.col("grp") % 2 == 1)


def remove_tags(tags: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Rows that stay. By default all depths are scrubbed; max_depth leaves deeper items alone."""
    reach = F.lit(True) if max_depth is None else F.col("depth") <= max_depth
    return tags.where(~(removable() & reach))


def hash_uid(uid: Column, salt: Column) -> Column:
    """2.25. and the decimal of the first 128 bits of the SHA-256 of salt:uid."""
    return F.concat(F.lit("2.25."), decimal_of_hex(F.substring(F.sha2(F.concat(salt, F.lit(":"), uid), 256), 1, 32)))


def replace_uids(tags: DataFrame, salt_col: str = "twin_id") -> DataFrame:
    """tags with the values of identifier tags at depth 0 made anew from salt_col."""
    return tags.withColumn("val", F.when(tag_in(UIDS) & (F.col("depth") == 0), hash_uid(F.col("val"), F.col(salt_col))).otherwise(F.col("val")))


def replace_identity(tags: DataFrame, marks: list[tuple] = IDENTITY) -> DataFrame:
    """tags(.., twin_id) with patient id, name and the two marks of de-identification set, one row each a file."""
    fixed = [(0x0010, 0x0020, "LO", F.col("twin_id")), *[(g, e, v, F.lit(x)) for g, e, v, x in marks]]
    new = tags.select("file_id", "twin_id").distinct().select("file_id", "twin_id", F.inline(F.array(*[F.struct(F.lit(0).alias("depth"), F.lit(g).alias("grp"), F.lit(e).alias("elem"), F.lit(v).alias("vr"), x.alias("val")) for g, e, v, x in fixed])))
    old = tags.where(~(tag_in([(g, e) for g, e, *_ in fixed]) & (F.col("depth") == 0)))
    return old.unionByName(new)


def pii_scan(df: DataFrame, text_col: str, key_cols: list[str], vr_col: str | None = None) -> DataFrame:
    """A row for each value and pattern that it matches, word ends by Unicode: (keys, pattern, excerpt of 50 characters)."""
    rows = df if vr_col is None else df.where(F.col(vr_col).isin(TEXT_VRS))
    hits = F.array_compact(F.array(*[F.when(F.col(text_col).rlike("(?U)" + p), F.lit(n)) for n, p in PII]))
    return rows.select(*key_cols, F.explode(hits).alias("pattern"), F.substring(F.col(text_col), 1, 50).alias("excerpt"))


def deidentify(tags: DataFrame, seed: str, content_sha: Column) -> tuple[DataFrame, DataFrame]:
    """(tags that stay, report). report: (file_id, twin_id, missing, removed, modified, warnings), counts a file.

    removed: tags dropped at depth 0; modified: the identity pair, the identifiers made anew, nested removals.
    """
    keys = patient_keys(tags, content_sha).select("file_id", twin_id(F.col("patient_key"), seed).alias("twin_id"), "missing")
    rows = tags.join(keys, "file_id")
    gone, top = removable(), F.col("depth") == 0
    kept = replace_uids(remove_tags(rows))
    counts = rows.groupBy("file_id", "twin_id", "missing").agg(
        F.count_if(gone & top).alias("removed"),
        (F.lit(2) + F.count_if(tag_in(UIDS) & top) + F.count_if(gone & ~top)).alias("modified"),
    )
    warned = pii_scan(kept, "val", ["file_id"], "vr").groupBy("file_id").agg(F.count("*").alias("warnings"))
    report = counts.join(warned, "file_id", "left").withColumn("warnings", F.coalesce("warnings", F.lit(0)))
    return replace_identity(kept.drop("missing")).drop("twin_id"), report


def case_name(path: Column, renamed: dict[str, str] | None = None) -> Column:
    """struct(case_id, patient, frame, is_truth) of an image or label file's path: the name without folders, without .nii or
    .nii.gz and without _gt, which marks ground truth, `renamed` pieces exchanged; patient and frame are what stands before
    and after _frame, null in names of other forms. A null path has a null name and is no truth."""
    stem = F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"\.nii(\.gz)?$", "")
    case = F.regexp_replace(stem, "_gt$", "")
    for old, new in (renamed or {}).items():
        case = F.replace(case, F.lit(old), F.lit(new))
    some = lambda pattern: F.nullif(F.regexp_extract(stem, pattern, 1), F.lit(""))
    return F.struct(case.alias("case_id"), some("^(.*?)_frame[0-9]+").alias("patient"), some("_frame([0-9]+)").cast("long").alias("frame"), F.coalesce(stem.endswith("_gt"), F.lit(False)).alias("is_truth"))
