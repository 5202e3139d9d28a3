"""Secret scans: candidates by pattern, false positives removed by a random forest.

DataFrame functions and the DataFrame-based forest of Spark ML only. A candidate is a run of at least 12
characters from A-Z a-z 0-9 + / _ - in a word, with a digit, a capital after a small letter, or a published
prefix; also the whole value, of any length and characters, after an assignment, after a word that announces a
credential, and between user and host of an address. Its features: length, shares of digits and of capitals, changes between character classes, different
characters, hexadecimal or not, dictionary coverage, path-like neighbourhood, an assignment in front, and
words before it that announce a credential.

The given tables have no labelled findings. `weak_labels` labels candidates by format: published prefixes
and assigned hexadecimal strings are secrets; runs of digits, plain words and candidates that are mostly words are not;
the rest stays unlabelled and is left to the forest. Training takes at most MAX_ROWS findings of each label.

Defined cases: NULL and empty texts have no candidates; without findings of both labels nothing can be
learnt, and every candidate counts as a secret with probability 1; equal candidates in a document are
listed each with its place, a value that is a run as well once; `redact` replaces runs wherever the document has
them and other values where no letter or digit adjoins them; other columns are kept by `redact` and ignored otherwise.
"""

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from chatlens.session import materialise, scratch_path
from chatlens.sizing import broadcast_if_small

MAX_ROWS = 10_000
TREES, DEPTH, SEED = 20, 6, 7
THRESHOLD = 0.5
MASK = "<SECRET>"
_RUN = r"[A-Za-z0-9+/_\-]{12,}"
_TELLING = r"[0-9]|[a-z][A-Z]|(AKIA|ASIA)[A-Z]{16}|gh[pousr]_|xox[abprs]-"
_OPEN, _CLOSE = r"[\"'`(\[{<]*", r"[\"'`)\]}>,;.]*"  # around a value
_ASSIGNED = f"^[^=:]*[=:]+{_OPEN}(.+?){_CLOSE}$"
_ADDRESS = "://[^:/@]*:(.+)@[^@]*$"  # with a password
_ANNOUNCE = r"(?i)(pass(word|wd)?|pwd|token|secret|api|key|auth|bearer|credential|private)"
# Common words and word parts of prose and code.
_DICTIONARY = (
    "the", "and", "ing", "tion", "ment", "that", "with", "for", "from", "this", "have", "not", "are", "you",
    "example", "test", "user", "name", "file", "path", "home", "data", "index", "value", "config", "default",
    "version", "mail", "com", "org", "www", "http", "que", "los", "las", "del", "con", "para", "les", "des",
    "pour", "dans", "und", "der", "die", "das", "ein", "sch", "keit", "ung", "eau", "aux", "ente", "able",
)
FEATURES = [
    "length", "digits", "capitals", "changes", "different", "hexadecimal", "dictionary", "path", "assigned", "announced",
]


def candidates(documents):
    """(key, doc_id, place, candidate, before, word): runs that could be secrets, with the text around them."""
    words = documents.select(
        F.xxhash64("doc_id", "text").alias("key"), "doc_id", F.split("text", r"[\x20\x09-\x0D]+").alias("words"))
    placed = words.select("key", "doc_id", "words", F.posexplode("words").alias("place", "word"))
    last = F.coalesce(F.get("words", F.col("place") - 1), F.lit(""))
    before = F.concat_ws(" ", F.get("words", F.col("place") - 2), F.get("words", F.col("place") - 1))
    holds = (F.length("word") >= 12) & F.col("word").rlike(_TELLING) & F.col("word").rlike(_RUN)
    follows = last.rlike("[=:]$") | (last.rlike(_ANNOUNCE) & ~last.rlike("[=:]."))
    some = placed.filter(holds | F.col("word").rlike("[=:].") | follows)
    runs = F.filter(F.regexp_extract_all("word", F.lit(f"({_RUN})"), 1), lambda c: c.rlike(_TELLING))
    whole = F.when(follows, F.regexp_extract("word", f"^{_OPEN}(.+?){_CLOSE}$", 1)).otherwise("")
    values = F.array(F.regexp_extract("word", _ASSIGNED, 1), F.regexp_extract("word", _ADDRESS, 1), whole)
    values = F.filter(F.array_except(values, runs), lambda c: c.rlike(r"[\p{L}\p{N}]"))
    return some.select(
        "key", "doc_id", "place", "word", before.alias("before"), F.explode(F.concat(runs, values)).alias("candidate"))


def described(found):
    """Candidates with their features."""
    c = F.col("candidate")
    size = F.length(c)

    def share(pattern):
        return F.regexp_count(c, F.lit(pattern)) / size

    uncovered = F.length(F.regexp_replace(F.lower(c), "|".join(_DICTIONARY), "")) / size
    return found.select(
        "*", size.cast("double").alias("length"), share("[0-9]").alias("digits"), share("[A-Z]").alias("capitals"),
        share("[a-z](?=[A-Z0-9])|[A-Z](?=[a-z0-9])|[0-9](?=[A-Za-z])").alias("changes"),
        (F.size(F.array_distinct(F.split(c, ""))) / size).alias("different"),
        c.rlike("^[0-9a-f]+$|^[0-9A-F]+$").cast("double").alias("hexadecimal"),
        (1 - uncovered).alias("dictionary"),
        (c.rlike("/[^/]+/") | F.col("before").rlike(r"[/\\]|\.[a-z]{1,4}$")).cast("double").alias("path"),
        F.coalesce((F.col("before").rlike("[=:]$") | F.col("word").rlike(f"[=:][\"']?{_RUN}")
                    | (F.regexp_extract("word", _ASSIGNED, 1) == c)), F.lit(False))
        .cast("double").alias("assigned"),
        (F.col("before").rlike(_ANNOUNCE) | F.regexp_extract("word", "^[^=:]*(?=[=:])", 0).rlike(_ANNOUNCE))
        .cast("double").alias("announced"),
    )


def weak_labels(found):
    """Candidates with a label where their format tells: 1 secret, 0 harmless."""
    c = F.col("candidate")
    published = c.rlike("^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[abprs]-|^eyJ[A-Za-z0-9_-]{16}")
    hexadecimal = c.rlike("^[0-9a-f]{16,}$") & c.rlike("[a-f]") & (F.col("announced") > 0)
    harmless = c.rlike("^[0-9-]+$") | (F.col("dictionary") >= 0.5) | c.rlike(r"^\p{L}\p{Ll}{0,11}$")
    return found.withColumn("label", F.when(published | hexadecimal, 1.0).when(harmless, 0.0)).filter("label IS NOT NULL")


def _assembler():
    return VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")


def train(findings, max_rows=MAX_ROWS):
    """A forest from labelled findings, or None if a label is missing."""
    order = F.xxhash64("candidate", "before", "key", "place")
    parts = [findings.filter(F.col("label") == v).orderBy(order).limit(max_rows) for v in (0.0, 1.0)]
    rows = materialise(parts[0].unionByName(parts[1]).select(*FEATURES, "label"), "findings")
    if rows.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt")
    path = scratch_path(findings.sparkSession, "forest")
    forest.fit(_assembler().transform(rows)).write().save(path)
    return RandomForestClassificationModel.load(path)  # without its training summary, which tasks can't carry


def scan(documents, labelled=weak_labels):
    """(key, doc_id, place, candidate, features, probability, is_secret) of every candidate.

    Without findings of both labels there is no forest: then what the labels mark as a secret is one, and no more.
    """
    found = materialise(described(candidates(documents)), "candidates")
    model = train(labelled(found))
    if model is None:
        secrets = labelled(found).filter("label = 1").select("key", "place", "candidate").distinct()
        judged = found.join(secrets.withColumn("probability", F.lit(1.0)), ["key", "place", "candidate"], "left").select(
            *found.columns, F.coalesce("probability", F.lit(0.0)).alias("probability"))
    else:
        judged = model.transform(_assembler().transform(found)).withColumn(
            "probability", vector_to_array("probability")[1]).drop("features", "rawPrediction", "prediction")
    return judged.withColumn("is_secret", F.col("probability") >= THRESHOLD)


def _literal(secret):
    """Pattern of a secret; a value that is no run only where no letter or digit adjoins."""
    quoted = F.concat(F.lit("\\Q"), F.replace(secret, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    bounded = F.concat(F.lit(r"(?<![\p{L}\p{N}])"), quoted, F.lit(r"(?![\p{L}\p{N}])"))
    return F.when(secret.rlike(f"^{_RUN}$"), quoted).otherwise(bounded)


def redact(documents, labelled=weak_labels):
    """The documents with every found secret replaced by MASK, all columns and rows kept."""
    lists = broadcast_if_small(
        scan(documents, labelled).filter("is_secret").groupBy(F.col("key").alias("secret_key"), F.col("doc_id").alias("secret_id"))
        .agg(F.sort_array(F.collect_set(F.struct(F.length("candidate").alias("size"), "candidate")), asc=False)["candidate"].alias("secrets")))
    same = (F.xxhash64(documents["doc_id"], documents["text"]) == lists["secret_key"]) & documents["doc_id"].eqNullSafe(
        lists["secret_id"])
    # One pass, the longest first, so that no mask is searched and no part of a secret stays.
    masked = F.regexp_replace(documents["text"], F.array_join(F.transform(lists["secrets"], _literal), "|"), F.lit(MASK))
    return documents.join(lists, same, "left").select(*[
        F.when(lists["secrets"].isNull(), documents["text"]).otherwise(masked).alias(c) if c == "text" else documents[c]
        for c in documents.columns
    ])
