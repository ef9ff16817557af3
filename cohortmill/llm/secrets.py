"""Secret scans: candidates by pattern, false positives removed by a random forest.

Native DataFrame and SQL functions throughout: candidates by Java regular expressions, features by
built-in functions, the forest by Spark's own DataFrame library.
"""

from __future__ import annotations

import json
import math
import string
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortmill.session import stored_bytes, written

CONTEXT = 40
#: Up to so many bytes of files the table of texts with secrets is broadcast.
BROADCAST_BYTES = 8 * 1024 * 1024
#: Words before a value that call it a secret, or that call it something else.
SECRET_WORDS = "token|secret|passw|passwd|password|pwd|api.?key|apikey|access.?key|private.?key|auth|bearer|credential|client.?secret"
PLAIN_WORDS = "sha1|sha256|md5|checksum|digest|etag|commit|revision|uuid|guid|href|src|url|http|www|image|id"
PLACEHOLDERS = "example|your|placeholder|changeme|dummy|sample|test|xxxx|0000|1234567|abcdef"
#: Any value of 8 or more characters that a secret word assigns, quoted or not; else a run of 16 or more characters
#: that tokens, keys and hashes are made of, "=" only as padding. What stands before a value is looked at in three steps,
#: the cheap ones first: a mark or blank, then an assignment, then the word.
CANDIDATE = rf"""(?<=[=:\s"'`])(?<=[=:]\s{{0,3}}["'`]?)(?<=(?i:{SECRET_WORDS})[a-zA-Z_]{{0,12}}["'`]?\s{{0,3}}[=:]\s{{0,3}}["'`]?)[^\s"'`=:][^\s"'`]{{7,}}|[A-Za-z0-9+/_-]{{16,}}={{0,2}}"""
FEATURES = ["length", "digits", "uppers", "lowers", "marks", "hex", "distinct", "class_changes", "vowel_steps", "transitions", "coverage", "secret_before", "plain_before", "assigned", "quoted", "placeholder", "path_tests", "path_config", "word_before", "slashes", "prefix"]


@dataclass(frozen=True)
class Lexicon:
    """What is learned from text: log-odds of letter pairs against chance, and frequent words of 4 or more letters."""

    pairs: dict[str, float]
    words: list[str]


def lexicon(texts: DataFrame, most: int = 500, text_col: str = "text") -> Lexicon:
    """The lexicon of texts(text), whose number the caller bounds. At most 26 * 26 pairs and `most` words reach the driver."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(F.col(f"`{text_col}`")), F.lit("[a-z]{2,}"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    top = words.where((F.length("w") >= 4) & (F.col("n") > 1)).orderBy(F.desc("n"), "w").limit(most).collect()
    steps = words.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring(F.col("w"), i, F.lit(2)))).alias("p"))
    pairs = {r.p: r.n for r in steps.groupBy("p").agg(F.sum("n").alias("n")).collect()}
    total = sum(pairs.values()) or 1
    odds = {a + b: math.log((pairs.get(a + b, 0) + 0.5) / (total + 338) * 676) for a in string.ascii_lowercase for b in string.ascii_lowercase}
    return Lexicon(odds, [r.w for r in top])


def _share(c: Column, pattern: str, n: Column) -> Column:
    return F.length(F.regexp_replace(c, pattern, "")) / n


def featured(candidates: DataFrame) -> DataFrame:
    """candidates (value, before, after, path) with what the forest sees of the whole value: length, changes of kind,
    the path and the neighbouring words; lexical() adds the rest."""
    v, before, path = F.col("value"), F.lower(F.coalesce("before", F.lit(""))), F.lower(F.coalesce("path", F.lit("")))
    n = F.greatest(F.length(v), F.lit(1))
    low = F.lower(v)
    near = F.substring(before, -24, 24)
    as_double = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[0-9]", "0"), "[A-Z]", "A"), "[a-z]", "a")
    return candidates.withColumns(
        {
            k: as_double(c)
            for k, c in {
                "length": F.log2(n),
                "digits": _share(v, "[^0-9]", n),
                "uppers": _share(v, "[^A-Z]", n),
                "lowers": _share(v, "[^a-z]", n),
                "marks": _share(v, "[A-Za-z0-9]", n),
                "hex": v.rlike("^([0-9a-f]+|[0-9A-F]+)$"),
                "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
                # a run of one class shrinks to one character: what is left over one counts the changes
                "class_changes": (F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1) / n,
                "vowel_steps": (n - F.length(F.regexp_replace(low, "[bcdfghjklmnpqrstvwxz][aeiouy]", "_"))) / n,
                "secret_before": near.rlike(SECRET_WORDS),
                "plain_before": F.substring(before, -14, 14).rlike(f"({PLAIN_WORDS})[^a-z0-9]*$"),
                "assigned": before.rlike(r"[=:]\s{0,3}[\"'`]?$"),
                "quoted": before.rlike("[\"'`]$") & F.coalesce("after", F.lit("")).rlike("^[\"'`]"),
                "placeholder": low.rlike(PLACEHOLDERS),
                "path_tests": path.rlike("test|spec|fixture|example|sample|doc"),
                "path_config": path.rlike(r"env|conf|secret|cred|\.ya?ml|\.ini|\.pem"),
                "word_before": F.regexp_extract(before, r"([a-z]+)[^a-z0-9]*$", 1) != "",
                "slashes": _share(v, "[^/]", n),
                "prefix": v.rlike("^(AKIA|ghp_|gho_|sk_|sk-|xox|AIza|glpat-|eyJ)"),
            }.items()
        }
    )


def lexical(candidates: DataFrame, known: Lexicon) -> DataFrame:
    """candidates with transitions, the mean log-odds of the value's letter pairs (pairs with other characters count -1), and
    coverage, the share of the value that dictionary words cover, longest first."""
    low = F.lower("value")
    n = F.greatest(F.length(low), F.lit(1))
    odds = F.from_json(F.lit(json.dumps(known.pairs)), "map<string,double>")
    steps = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.coalesce(F.element_at(odds, F.substring(low, i, F.lit(2))), F.lit(-1.0)))
    covered = F.length(F.regexp_replace(low, "|".join(sorted(known.words, key=lambda w: (-len(w), w))), "")) if known.words else n
    return candidates.withColumns({"transitions": F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / F.size(steps), "coverage": (n - covered) / n})


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, version, part, value, start, before, after, path, *extra): every match of CANDIDATE that has letters and digits
    or changes of case, or that a secret word stands before. extra: columns of docs that come along.

    A text is split at its candidates once; part numbers them, start is a code point from 0. Only texts
    with a candidate leave the scan; the window that adds up lengths is over the parts of one text.
    """
    text = F.col(f"`{text_col}`").cast("string")
    path = F.col(f"`{path_col}`").cast("string") if path_col and path_col in docs.columns else F.lit("")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("t"), path.alias("path"), *extra).where(F.col("t").rlike(CANDIDATE))
    rows = rows.select("id", "path", *extra, F.xxhash64("t").alias("version"), F.split("t", CANDIDATE, -1).alias("gaps"), F.regexp_extract_all("t", F.lit(CANDIDATE), F.lit(0)).alias("values"))
    parts = rows.select("id", "version", "path", *extra, "gaps", F.posexplode("values").alias("part", "value"))
    gap = F.element_at("gaps", F.col("part") + 1)
    parts = parts.select("id", "version", "path", *extra, "part", "value", F.length(gap).alias("gap"), F.substring(gap, -CONTEXT, CONTEXT).alias("before"), F.substring(F.element_at("gaps", F.col("part") + 2), 1, CONTEXT).alias("after")).distinct()
    order = Window.partitionBy("id", "version").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.col("gap") + F.length("value")).over(order) - F.length("value")
    # plain words and numbers are no candidates, however long, unless something before them says so
    worth = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]") | F.col("value").rlike("[a-z][A-Z].*[a-z][A-Z]") | F.lower("before").rlike(f"({SECRET_WORDS})")
    return parts.withColumn("start", start).where(worth).drop("gap")


def sample_of(docs: DataFrame, sample: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) of up to `sample` documents, whole texts, the least by hash of the id; null ids or texts and repeats left out.
    Ids compete alone, texts of those chosen follow; the result is written, so that what is learned from it reads docs once."""
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    rows = docs.where(id_.isNotNull() & text.isNotNull()).select(id_.alias("id"), text.alias("text"))
    ids = rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    return written(rows.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text")), "sample")[0]


def labelled_findings(docs: DataFrame, sample: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labelled findings (value, before, after, path, label) where no reviewed ones are at hand.

    Made by Spark from up to `sample` documents (sample_of): each gives prose into which findings are set, true ones, keys and
    passwords of several shapes drawn by hash functions in assignments, and false ones, the same shapes in
    places that call them digests, commits, ids, links or placeholders, and plain words. The texts so made go through
    candidates(), as every text does that is scanned; what it finds of the findings is labelled.
    """
    base = sample_of(docs, sample, id_col, text_col).select("id", F.translate("text", "\n\"'`=:", "      ").alias("t"))
    salt = lambda s: F.concat(F.lit(s), F.col("id").cast("string"))
    place = F.pmod(F.xxhash64("id"), F.greatest(F.length("t") - 80, F.lit(1))).cast("int") + 1
    name = lambda k, *of: F.element_at(F.array(*map(F.lit, of)), (F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(len(of))) + 1).cast("int"))
    word = F.regexp_extract(F.regexp_replace(F.lower("t"), "[^a-z ]", ""), r"(\S+ \S+ \S+ \S+)", 1)
    # what findings are made of, written first: shape by shape it is only put together, which keeps the generated code small
    pieces = {
        "hex40": F.sha1(salt("a")),
        "hex64": F.sha2(salt("b"), 256),
        "hex32": F.md5(salt("c")),
        "b64": F.translate(F.regexp_replace(F.base64(F.unhex(F.sha2(salt("d"), 256))), "=", ""), "+/", "-_"),
        "bare": F.substring(F.col("t"), place, F.lit(30)),
        "after": F.substring(F.col("t"), place + 40, F.lit(30)),
        "true_word": name("n", "token", "secret", "password", "api_key", "apikey", "access_key", "auth_token", "client_secret", "passwd"),
        "sep": name("s", ' = "', '="', ': "', " = '", "=", ": "),
        "false_sep": name("f", ' = "', '="', ": ", " ", "="),
        "commit": name("g", "commit", "revision", "merge", "sha1:", "etag"),
        "sum": name("h", "sha256", "checksum", "digest"),
        "number": name("i", "md5", "uuid", "id", "image id", "guid"),
        "long_word": F.substring(F.regexp_replace(F.concat(word, F.lit("internationalisation")), " ", ""), 1, 28),
    }
    base = written(base.select("id", *[x.alias(k) for k, x in pieces.items()]), "pieces")[0]
    alnum, plain = F.regexp_replace("b64", "[-_]", ""), F.regexp_extract(F.lower("bare"), "([a-z]{8,})", 1)
    close = lambda s: F.concat(F.regexp_extract(s, "[\"']", 0), F.lit(" "), "after")
    more = {
        "alnum": alnum,
        "short": F.concat(F.substring(alnum, 1, 5), F.lit("!"), F.substring(alnum, 6, 3), F.lit("@"), F.substring(alnum, 9, 3)),
        "plain": F.when(plain == "", "something").otherwise(plain),
        "close": close("sep"),
        "false_close": close("false_sep"),
        "prose": F.concat("bare", F.lit(" ")),
        "assigned": F.concat("bare", F.lit(" "), "true_word", "sep"),
    }
    base = written(base.withColumns(more), "pieces")[0]
    hex40, hex64, hex32, b64, alnum, prose, after, end, assigned = map(F.col, ("hex40", "hex64", "hex32", "b64", "alnum", "prose", "after", "close", "assigned"))
    said = lambda *x: F.concat(prose, *[F.col(c) if c in pieces else F.lit(c) for c in x])
    shapes = [
        (F.col("short"), assigned, end, "", 1),
        (F.substring(alnum, 1, 12), assigned, end, "src7", 1),
        (F.col("plain"), said("true_word", ": "), F.concat(F.lit(" "), after), "src8", 0),
        *[(v, assigned, end, p, 1) for v, p in ((hex40, "src/app.py"), (hex32, "config.env"), (b64, "deploy/settings.yml"), (alnum, ""), (hex64, "src0"), (F.concat(F.lit("ghp_"), F.substring(alnum, 1, 36)), ""), (F.concat(F.lit("AKIA"), F.upper(hex32)), "env"), (F.substring(hex40, 1, 24), "src1"))],
        (b64, said("Authorization: Bearer "), F.concat(F.lit("\n"), after), "src/client.js", 1),
        (hex40, said("commit", " "), after, "docs/changes.md", 0),
        (hex64, said("sum", "false_sep"), F.col("false_close"), "package.lock", 0),
        (hex32, said("number", "false_sep"), F.col("false_close"), "src2", 0),
        (hex40, F.col("bare"), after, "src3", 0),
        (alnum, said("https://www.example.com/watch/"), after, "src4", 0),
        (b64, said('<img src="data:image/png;base64,'), after, "index.html", 0),
        (F.lit("your_token_goes_here_please"), assigned, end, "docs/readme.md", 0),
        (F.lit("xxxxxxxxxxxxxxxx00000000"), assigned, end, "test/fixtures.py", 0),
        (F.concat(F.lit("example_"), F.substring(hex32, 1, 16)), assigned, end, "example.env", 0),
        (F.col("long_word"), prose, after, "src5", 0),
        (F.col("long_word"), said("true_word", " "), after, "", 0),
        (F.concat("long_word", F.lit("2024")), said("the ", "true_word", " of "), after, "src6", 0),
    ]
    made = F.posexplode(F.array(*[F.struct(v.alias("want"), F.concat(b, v, a).alias("text"), F.lit(p).alias("path"), F.lit(y).cast("double").alias("label")) for v, b, a, p, y in shapes])).alias("k", "x")
    texts = written(base.select("id", made).select(F.concat_ws(":", F.col("id").cast("string"), "k").alias("id"), "x.*"), "made")[0]
    found = candidates(texts, "id", "text", "path", ("want", "label")).where("value = want")
    return found.select("value", "before", "after", "path", "label")


@dataclass(frozen=True)
class SecretModel:
    forest: PipelineModel
    known: Lexicon

    def transform(self, rows: DataFrame) -> DataFrame:
        """featured() candidates with the forest's verdict."""
        return self.forest.transform(lexical(rows, self.known))


def train(findings: DataFrame, texts: DataFrame | None = None, trees: int = 40, depth: int = 8, seed: int = 7) -> SecretModel | None:
    """A random forest over labelled findings (value, before, after, path, label 0/1), whose number the caller bounds; letter
    pairs and words are learned from texts(text), by default from what stands around the findings. Findings without a value or a
    label teach nothing. Without findings there is no forest: None, with which nothing is called a secret."""
    findings, _ = written(findings.where("value is not null and label is not null"), "findings")
    if findings.isEmpty():
        return None
    known = lexicon(findings.select(F.concat_ws(" ", "before", "after").alias("text")) if texts is None else texts)
    rows = lexical(featured(findings), known).select("label", *FEATURES)
    rows = rows.repartitionByRange(1, "label", *FEATURES)  # bagging draws by partition and order: the same rows, the same forest
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label", featureSubsetStrategy="sqrt", cacheNodeIds=False)
    return SecretModel(Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(rows), known)


def scanned(docs: DataFrame, model: SecretModel | None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """Every candidate of every whole text with the forest's score and verdict.

    (id_col, version, part, start, end, value, score, is_secret): positions are code points, end exclusive;
    version is the text's hash, which tells rows of one id apart; repeated rows are reported once. Null and
    empty texts have no candidates; a null id is reported as null; an empty table gives an empty result;
    columns of docs other than the named are not read. Texts and values are read whole, however long.
    """
    found = candidates(docs, id_col, text_col, path_col)
    found = model.transform(featured(found)) if model else found
    score = vector_to_array("probability")[1] if model else F.lit(0.0)
    return found.select(F.col("id").alias(id_col), "version", "part", F.col("start").cast("long").alias("start"), (F.col("start") + F.length("value")).cast("long").alias("end"), "value", score.alias("score"), (score >= 0.5).alias("is_secret"))


def redacted(docs: DataFrame, model: SecretModel | None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", mark: str = "[secret]") -> DataFrame:
    """docs with each confirmed secret replaced by `mark`; all rows and columns stay.

    A value that is confirmed in one place of a text is replaced wherever it is a candidate in that text. The few texts
    with secrets are matched by hash of the text, so null and repeated ids do no harm; null, empty and long texts
    stay as they are but for their secrets. docs may have any columns but __version and __values, which raise an error.
    The table of what to replace is broadcast if its files are small, which is looked up; else texts are joined with it.
    """
    if {"__version", "__values"} & set(docs.columns):
        raise ValueError("docs has a column __version or __values")
    spark = docs.sparkSession
    hits = scanned(docs, model, id_col, text_col, path_col).where("is_secret").select(F.col("version").alias("__version"), "value").distinct()
    hits, path = written(hits.groupBy("__version").agg(F.sort_array(F.collect_list("value")).alias("__values")), "hits")
    text = F.col(f"`{text_col}`")
    version = F.xxhash64(text.cast("string"))
    if stored_bytes(spark, path) <= BROADCAST_BYTES:
        # a hash a text tells which ones hold secrets; the pattern runs over those alone
        rows, rest = docs.withColumn("__version", version).join(F.broadcast(hits), "__version", "left"), None
    else:
        # only texts with a candidate are shuffled
        found = docs.withColumn("__version", F.when(text.rlike(CANDIDATE), version))
        rest = found.where("__version is null").select(*docs.columns)
        rows = found.where("__version is not null").join(hits.hint("merge"), "__version", "left")
    values = F.regexp_extract_all(text.cast("string"), F.lit(CANDIDATE), F.lit(0))
    shown = F.transform(F.arrays_zip(F.split(text, CANDIDATE, -1).alias("g"), F.concat(values, F.array(F.lit(""))).alias("v")), lambda x: F.concat(x["g"], F.when(F.array_contains("__values", x["v"]), F.lit(mark)).otherwise(x["v"])))
    clean = F.when(F.col("__values").isNotNull(), F.array_join(shown, "")).otherwise(text)
    out = rows.withColumn(text_col, clean).select(*docs.columns)
    return out if rest is None else rest.unionByName(out)
