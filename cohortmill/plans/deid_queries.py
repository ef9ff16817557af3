"""Queries of de-identification and text functions (X) and of the registry (U)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortmill.functions.hashing import hmac_pads, id_format_ok
from cohortmill.operators import deid, registry
from cohortmill.plans.base import query
from cohortmill.session import shared_dir

SEED = "seed of the registered queries"
_IN, _OUT = (p.hex() for p in hmac_pads(SEED))
_TAG = "(grp * 65536 + elem)"
_REMOVED = "(" + ", ".join(str(g * 65536 + e) for g, e in deid.REMOVED) + ")"
_GONE = f"({_TAG} IN {_REMOVED} OR grp % 2 = 1)"
_UIDS = "(" + ", ".join(str(g * 65536 + e) for g, e in deid.UIDS) + ")"


def _hmac(c: str) -> str:
    return f"sha256(unhex('{_OUT}') || unhex(sha256(unhex('{_IN}') || encode({c}))))"


def _uid(salt: str, uid: str) -> str:
    h = f"sha256({salt} || ':' || {uid})"
    limb = lambda k: f"CAST(CAST('0x' || substr({h}, {1 + 8 * k}, 8) AS UBIGINT) AS UHUGEINT)"
    return f"'2.25.' || CAST({limb(0)} * 79228162514264337593543950336::UHUGEINT + {limb(1)} * 18446744073709551616::UHUGEINT + {limb(2)} * 4294967296::UHUGEINT + {limb(3)} AS VARCHAR)"


@query(f"SELECT c_custkey, {_hmac('c_name')} AS twin_id FROM customer")
def x01_twin_id(t):
    return t.customer.select("c_custkey", deid.twin_id(F.col("c_name"), SEED).alias("twin_id"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def x02_content_sha256(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"))


_KEYS = """SELECT file_id, coalesce(nullif(trim(max(CASE WHEN depth = 0 AND grp = 16 AND elem = 32 THEN val END)), ''), sha256(CAST(file_id AS VARCHAR))) AS patient_key,
  nullif(trim(max(CASE WHEN depth = 0 AND grp = 16 AND elem = 32 THEN val END)), '') IS NULL AS missing FROM v_tags GROUP BY file_id"""
_SHA = lambda: F.sha2(F.col("file_id").cast("string"), 256)


@query(_KEYS)
def x03_patient_key(t):
    return deid.patient_keys(t.v_tags, _SHA())


@query(f"SELECT file_id, count(*) AS n_kept, CAST(sum(grp) AS BIGINT) AS groups FROM v_tags WHERE NOT {_GONE} OR depth > 0 GROUP BY file_id")
def x04_remove_tags(t):
    return deid.remove_tags(t.v_tags, max_depth=0).groupBy("file_id").agg(F.count("*").alias("n_kept"), F.sum("grp").alias("groups"))


@query(f"WITH k AS ({_KEYS}) SELECT file_id, {_uid(_hmac('patient_key'), 'val')} AS new_uid FROM v_tags JOIN k USING (file_id) WHERE {_TAG} IN {_UIDS} AND depth = 0")
def x05_hash_uid(t):
    keys = deid.patient_keys(t.v_tags, _SHA()).select("file_id", deid.twin_id(F.col("patient_key"), SEED).alias("twin_id"))
    rows = t.v_tags.join(keys, "file_id").where(deid.tag_in(deid.UIDS) & (F.col("depth") == 0))
    return rows.select("file_id", deid.hash_uid(F.col("val"), F.col("twin_id")).alias("new_uid"))


@query(f"""WITH k AS ({_KEYS}), f AS (SELECT file_id, {_hmac('patient_key')} AS twin_id FROM k), g(grp, elem, vr, val) AS (VALUES (16, 32, 'LO', NULL), (16, 16, 'PN', 'ANON^ANONYMIZED'), (18, 99, 'LO', 'PS3.15-BasicProfile'), (18, 98, 'CS', 'YES'))
SELECT file_id, depth, grp, elem, vr, val FROM v_tags WHERE NOT (depth = 0 AND {_TAG} IN (1048608, 1048592, 1179747, 1179746))
UNION ALL SELECT file_id, 0, grp, elem, vr, coalesce(val, twin_id) FROM f CROSS JOIN g""")
def x06_replace_identity(t):
    keys = deid.patient_keys(t.v_tags, _SHA()).select("file_id", deid.twin_id(F.col("patient_key"), SEED).alias("twin_id"))
    return deid.replace_identity(t.v_tags.join(keys, "file_id")).drop("twin_id")


@query(f"SELECT depth, count(*) AS n_before, count_if(NOT {_GONE}) AS n_after FROM v_tags GROUP BY depth")
def x07_scrub_nested(t):
    after = deid.remove_tags(t.v_tags).groupBy("depth").agg(F.count("*").alias("n_after"))
    before = t.v_tags.groupBy("depth").agg(F.count("*").alias("n_before"))
    return before.join(after, "depth", "left").withColumn("n_after", F.coalesce("n_after", F.lit(0)))


# RE2 knows word ends of ASCII only
_ENDS = [(n, r"(^|[^\p{L}\p{N}_])" + p[2:-2] + r"($|[^\p{L}\p{N}_])") for n, p in deid.PII]
_PII = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS pattern, substr(text, 1, 50) AS excerpt FROM documents WHERE regexp_matches(text, '{p}')" for n, p in _ENDS)


@query(_PII)
def x08_pii_scan(t):
    return deid.pii_scan(t.documents, "text", ["doc_id"])


@query(f"""WITH k AS ({_KEYS}), r AS (SELECT v.*, {_hmac('patient_key')} AS twin_id, missing FROM v_tags v JOIN k USING (file_id)),
w AS (SELECT file_id, count(*) AS warnings FROM (SELECT file_id, unnest(CASE WHEN regexp_matches(val, '{deid.PII[0][1]}') THEN ['d'] ELSE [] END || CASE WHEN regexp_matches(val, '{deid.PII[1][1]}') THEN ['n'] ELSE [] END) AS p
  FROM r WHERE NOT {_GONE} AND vr IN ('LO', 'LT', 'SH', 'ST', 'PN', 'UT')) GROUP BY 1)
SELECT r.file_id, any_value(twin_id) AS twin_id, any_value(missing) AS missing, count_if({_GONE} AND depth = 0) AS removed,
  2 + count_if({_TAG} IN {_UIDS} AND depth = 0) + count_if({_GONE} AND depth > 0) AS modified, coalesce(any_value(w.warnings), 0) AS warnings
FROM r LEFT JOIN w ON w.file_id = r.file_id GROUP BY r.file_id""")
def x09_deidentify(t):
    return deid.deidentify(t.v_tags, SEED, _SHA())[1]


@query(f"SELECT c_custkey, regexp_matches({_hmac('c_name')}, '^[a-f0-9]{{64}}$') AS hashed_ok, regexp_matches(c_name, '^[a-f0-9]{{64}}$') AS raw_ok FROM customer")
def x10_id_format(t):
    return t.customer.select("c_custkey", id_format_ok(deid.twin_id(F.col("c_name"), SEED)).alias("hashed_ok"), id_format_ok(F.col("c_name")).alias("raw_ok"))


@query(r"SELECT page_id, regexp_extract(url, '/([a-z]{2})/[0-9]+', 1) AS case_lang, CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT) AS frame, regexp_replace(url, '^https?://(www\.)?|[/?#].*$', '', 'g') AS case_id FROM pages")
def x11_case_id(t):
    return t.pages.select(
        "page_id",
        F.regexp_extract("url", "/([a-z]{2})/[0-9]+", 1).alias("case_lang"),
        F.nullif(F.regexp_extract("url", "/([0-9]+)", 1), F.lit("")).cast("long").alias("frame"),
        F.regexp_replace("url", r"^https?://(www\.)?|(?<=[^/:])[/?#].*$", "").alias("case_id"),
    )


_FILES = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'in/patient' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '_frame' || lpad(CAST(n_chars % 30 AS VARCHAR), 2, '0') || '.nii.gz'
 WHEN 1 THEN 'patient' || doc_id || '_frame' || (n_chars % 30) || '_gt.nii.gz' WHEN 2 THEN 'mr/mr_train_' || doc_id || '_image.nii' ELSE 'odd name ' || doc_id END AS path FROM documents"""


@query(f"""WITH f AS ({_FILES}), n AS (SELECT doc_id, regexp_replace(regexp_replace(path, '^.*/', ''), '\\.nii(\\.gz)?$', '') AS stem FROM f)
SELECT doc_id, replace(regexp_replace(stem, '_gt$', ''), 'mr_train_', 'mmwhs_') AS case_id, nullif(regexp_extract(stem, '^(.*?)_frame[0-9]+', 1), '') AS patient, CAST(nullif(regexp_extract(stem, '_frame([0-9]+)', 1), '') AS BIGINT) AS frame, ends_with(stem, '_gt') AS is_truth FROM n""")
def x11_case_names(t):
    """Case names of image and label files of two data sets, and names of no known form."""
    path = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("in/patient"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit("_frame"), F.lpad((F.col("n_chars") % 30).cast("string"), 2, "0"), F.lit(".nii.gz")))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("patient"), "doc_id", F.lit("_frame"), F.col("n_chars") % 30, F.lit("_gt.nii.gz")))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("mr/mr_train_"), "doc_id", F.lit("_image.nii")))
        .otherwise(F.concat(F.lit("odd name "), "doc_id"))
    )
    return t.documents.select("doc_id", deid.case_name(path, {"mr_train_": "mmwhs_"}).alias("c")).select("doc_id", "c.*")


def _twins(t):
    return t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("twin_id"), F.lit("ready").alias("status"), F.lit(True).alias("consent"), F.lit("1990-01-01").cast("timestamp").alias("updated_at"))


@query("""WITH q AS (SELECT o_custkey AS twin_id, max(o_orderdate) AS at FROM orders GROUP BY 1), t AS (SELECT c_custkey AS twin_id FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(t.twin_id, q.twin_id) AS twin_id, CASE WHEN q.twin_id IS NULL THEN 'ready' ELSE 'ingesting' END AS status, t.twin_id IS NOT NULL AS consent,
  epoch(coalesce(q.at, TIMESTAMP '1990-01-01')) AS at_s FROM t FULL JOIN q ON t.twin_id = q.twin_id""")
def u01_upsert_twins(t):
    asked = t.orders.select(F.col("o_custkey").alias("twin_id"), F.lit(False).alias("consent"), F.col("o_orderdate").cast("timestamp").alias("at"))
    return registry.upsert_twins(_twins(t), asked).select("twin_id", "status", "consent", F.col("updated_at").cast("double").alias("at_s"))


@query("""WITH q AS (SELECT o_custkey AS twin_id, max(o_orderdate) AS at FROM orders GROUP BY 1), t AS (SELECT c_custkey AS twin_id FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(t.twin_id, q.twin_id) AS twin_id, CASE WHEN q.twin_id IS NULL THEN 'ready' ELSE 'ingesting' END AS status, t.twin_id IS NOT NULL AS consent,
  epoch(coalesce(q.at, TIMESTAMP '1990-01-01')) AS at_s FROM t FULL JOIN q ON t.twin_id = q.twin_id""")
def u01_upsert_versioned(t):
    """The same upsert into a table of files by hash of the key: a first version of the twins, then the requests in two
    batches, each of which rewrites the parts that it touches."""
    from cohortmill.operators.versioned import VersionedTable

    twins = _twins(t)
    asked = t.orders.select(F.col("o_custkey").alias("twin_id"), F.lit(False).alias("consent"), F.col("o_orderdate").cast("timestamp").alias("at"))
    table = VersionedTable(t.spark, f"{shared_dir(t.spark)}/twins-{uuid.uuid4().hex}", "twin_id", twins.schema, parts=16)
    table.upsert(twins, lambda old, new: new)
    late = F.col("twin_id") % 5 == 0
    table.upsert(asked.where(~late), registry.upsert_twins)
    table.upsert(asked.where(late), registry.upsert_twins)
    return table.read().select("twin_id", "status", "consent", F.col("updated_at").cast("double").alias("at_s"))


@query("SELECT o_orderkey AS job_id, o_custkey AS twin_id, 'done' AS status, 0 AS size, '' AS sha256 FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_custkey, 'pending', length(o_orderpriority), sha256(o_orderpriority) FROM orders WHERE o_orderkey % 2 = 1")
def u02_register_jobs(t):
    o = t.orders.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("twin_id"), "o_orderpriority")
    jobs = o.where("job_id % 2 = 0").select("job_id", "twin_id", F.lit("done").alias("status"), F.lit(0).alias("size"), F.lit("").alias("sha256"))
    return registry.register_jobs(jobs, o.where("job_id % 2 = 1").select("job_id", "twin_id", F.length("o_orderpriority").alias("size"), F.sha2("o_orderpriority", 256).alias("sha256")))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS action, count(*) AS n, count(DISTINCT user_id) AS subjects FROM events GROUP BY 1, 2")
def u03_append_audit(t):
    rows = registry.audit_events(t.events, F.lit("ingest"), F.col("event_type"), F.col("user_id"), F.col("ts"))
    return rows.groupBy(F.col("day").cast("string").alias("day"), "action").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("subjects"))


@query("""SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 3 = 0 THEN 'completed' ELSE o_orderstatus END AS status,
 CASE WHEN o_orderkey % 3 = 0 THEN '2024-01-31' ELSE NULL END AS completed_at, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS twin_id FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""")
def u04_upsert_status(t):
    jobs = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("completed_at"), F.col("o_custkey").alias("twin_id"))
    changes = t.orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("job_id"), F.lit("completed").alias("status"), F.lit("2024-01-31").alias("completed_at"))
    return registry.upsert_status(jobs, changes)


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS label FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def u05_insert_if_absent(t):
    old = t.part.where("p_partkey % 2 = 0").select("p_partkey", F.col("p_brand").alias("label"))
    return registry.insert_if_absent(old, t.part.where("p_partkey % 3 = 0").select("p_partkey", F.col("p_type").alias("label")), "p_partkey")


@query("SELECT c_custkey AS o_orderkey, o_orderstatus AS status, CASE WHEN c_custkey % 7 = 0 THEN 'bad_format' WHEN o_orderkey IS NULL THEN 'not_found' ELSE 'ok' END AS found FROM customer LEFT JOIN orders ON o_orderkey = c_custkey")
def u06_lookup(t):
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return registry.lookup(t.customer.select(F.col("c_custkey").alias("o_orderkey")), rows, "o_orderkey", F.col("o_orderkey") % 7 != 0)


_STATE = "CASE event_id % 4 WHEN 0 THEN 'created' WHEN 1 THEN 'simulating' WHEN 2 THEN 'completed' ELSE 'failed' END"
_LEGAL = ", ".join(f"'{a}>{b}'" for a, b in registry.FOLLOWS)


@query(f"""WITH e AS (SELECT user_id, ts, event_id, {_STATE} AS s, lag({_STATE}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM e)
SELECT user_id, max(CASE WHEN r = 1 THEN s END) AS state, count(*) AS n_events, count_if(p IS NOT NULL AND p <> s AND p || '>' || s NOT IN ({_LEGAL})) AS n_illegal FROM l GROUP BY 1""")
def u07_twin_state(t):
    state = F.element_at(F.array(*map(F.lit, registry.STATES)), (F.col("event_id") % 4 + 1).cast("int"))
    return registry.twin_state(t.events, "user_id", state, ["ts", "event_id"])


@query("""WITH l AS (SELECT l_orderkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_linenumber > 2 GROUP BY 1)
SELECT o_orderkey, o_custkey, l.n AS items_n, l.quantity AS items_quantity, c_name AS customer_name, l.n IS NOT NULL AND c_custkey IS NOT NULL AS complete
FROM orders LEFT JOIN l ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 5 > 0""")
def u08_lineage(t):
    items = t.lineitem.where("l_linenumber > 2").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    base = t.orders.select("o_orderkey", "o_custkey")
    who = base.join(t.customer.where("c_custkey % 5 > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name")), "o_custkey").select("o_orderkey", "name")
    return registry.attribute_lineage(base, {"items": items, "customer": who}, ["o_orderkey"])
