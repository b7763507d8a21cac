"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is a private key block (one without an end: its lines of key characters), a value
of 6 or more characters other than spaces and quotes after a key word's assignment, however far
and long, the password of a URL's user:password@host, a run
of 12 or more key characters with a digit or with a capital after a small letter, or of 16 or
more capitals.  A value ends before a closing sign and before the next assignment of a list.
Its features are its length, the shares of character kinds,
changes between kinds, the mean log-probability of its letter transitions and the coverage
of its letter runs by dictionary words (both learned from all words of all texts that lie
outside candidates), its path, and the words beside it.  The forest is trained on labelled findings and gives
every candidate a probability of being a secret.

Labelled findings are a parameter.  ``told_findings`` makes a table of them by rule (random
keys in assignments and provider formats; numbers, shouted words, identifiers, placeholders,
checksums in prose), and ``rule_labels`` adds all of the scanned candidates on which a
strict rule is sure.

Everything is DataFrame functions and the DataFrame API of ``pyspark.ml``.  Texts without a
candidate never leave their scan; equal texts of one path are judged once.

Defined results: null and empty texts have no findings and stay as they are; null paths are
empty; repeated rows have the same findings; candidates in one text are ordered by place and
never overlap; an empty table gives no findings.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomgrid.session import scratch_path

# key characters; a match begins and ends at their border
_K = r"A-Za-z0-9_+/\-"
MASK = "[SECRET]"
AROUND = 48
CUT = 0.5
FIT_ROWS = 100_000     # rows of a training partition
TREES, DEPTH = 30, 8

KEY_WORDS = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_\- ]?key|access[_\- ]?key|auth|bearer|credential|private[_\- ]?key)"
_KEY_WORD = "(?i:" + KEY_WORDS[4:].replace("(", "(?:") + ")"
HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "://")   # one is in every such text
# what stands between a key word and its value: access_key = ", "password": ', auth: Bearer
_ASSIGN = r"(?:[_\-]?key)?[\"']?\s*(?>:=|=>|[:=])\s*+(?:(?i:bearer|basic)\s+)?+[\"']?"
_V = r"\s\"'`<>"                 # never in a value
_LISTED = r"[&,;](?!\w+[=:])"    # a sign that no other assignment of a list follows
_SHUT = r".,;:)\]}"              # closing signs, never the last of a value
# a value of 6 or more characters, up to the next assignment of its list, white space or quote
_VALUE = (rf"(?=(?:[^{_V}&,;]|{_LISTED}){{6}})[^{_V}]+?(?<![{_SHUT}])"
          rf"(?=[{_SHUT}]*(?:[&,;]\w+[=:]|[{_V}]|\z))")
_URL = r"://[^\s:/@]*:"
_BLOCK = (r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"
          r"|\s*[A-Za-z0-9+/=]{16,}[A-Za-z0-9+/=\s]*(?<!\s))")      # or open, as in a cut text
# Each candidate in a text is put between two marks (private-use characters; those of a text
# count as another one).  First values beside key words, in URLs and key blocks, whose left
# parts are read over; then runs of key characters elsewhere.
_FROM, _TO, _OTHER = "\ue000", "\ue001", "\ue002"
_TOLD = (rf"({_KEY_WORD}{_ASSIGN})(?!\[SECRET\])({_VALUE})|({_URL})(?!\[SECRET\])([^\s/\"'<>]{{3,}})(?=@[A-Za-z0-9\[])|({_BLOCK})")
_RUN = (rf"(?<![{_K}])(?=[{_K}]{{12}})(?:(?=[A-Za-z_+/\-]*[0-9])[{_K}]{{12,}}"
        rf"|(?=[0-9A-Z_+/\-]*[a-z][0-9a-z_+/\-]*[A-Z])[{_K}]{{12,}}|[A-Z]{{16,}})(?![{_K}])={{0,2}}")
_RUN_BESIDE = rf"({_FROM}[^{_TO}]*+{_TO})|({_RUN})"

TEST_WORDS = r"(?i)(example|sample|dummy|placeholder|changeme|your|test|xxxx|fake)"
PROVIDER = r"^(AKIA[A-Z0-9]{16}|ASIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9\-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|-----BEGIN )"

FEATURES = ["length", "digits", "uppers", "lowers", "signs", "changes", "hex", "kinds_seen", "transition", "coverage",
            "repeated", "path_hash", "path_test", "key_left", "assigned", "quoted", "test_near", "provider", "left_hash", "alone", "in_url"]


def marked(text: Column) -> Column:
    """The text with each candidate between ``_FROM`` and ``_TO``: one pass for the values
    beside key words, in texts that hold a hint of any, and one for the runs."""
    plain = F.replace(F.replace(text, F.lit(_FROM), F.lit(_OTHER)), F.lit(_TO), F.lit(_OTHER))
    low = F.lower(plain)
    hinted = F.contains(plain, F.lit("PRIVATE KEY"))
    for h in HINTS:
        hinted = hinted | F.contains(low, F.lit(h))
    told = F.regexp_replace(plain, _TOLD, f"$1$3{_FROM}$2$4$5{_TO}")
    beside = F.replace(F.regexp_replace(told, _RUN_BESIDE, f"$1{_FROM}$2{_TO}"), F.lit(_FROM + _TO), F.lit(""))
    return F.when(hinted, beside).otherwise(F.regexp_replace(plain, _RUN, f"{_FROM}$0{_TO}"))


def with_candidates(docs: DataFrame, text_col: str, **more: Column) -> DataFrame:
    """(text, marks, and the given columns) of the rows with at least one candidate."""
    rows = docs.select(F.col(text_col).alias("text"), marked(F.col(text_col)).alias("marks"), *[c.alias(n) for n, c in more.items()])
    return rows.filter(F.contains("marks", F.lit(_FROM)))


def candidates(texts: DataFrame) -> DataFrame:
    """(key, path, text, marks) -> (key, path, n, start, value, left, right), by place."""
    cut = texts.withColumn("_s", F.split("marks", _FROM, -1))
    t = cut.select("key", "path", "text",
                   F.expr(f"transform(slice(_s, 2, size(_s)), x -> substring_index(x, '{_TO}', 1))").alias("_f"),
                   F.expr(f"transform(_s, x -> substring_index(x, '{_TO}', -1))").alias("_p"))
    t = t.select("key", "path", "text", "_f", "_p", F.posexplode("_f").alias("n", "value"))
    start = F.expr("aggregate(slice(_p, 1, n + 1), 0L, (a, x) -> a + length(x))"
                   " + aggregate(slice(_f, 1, n), 0L, (a, x) -> a + length(x))")
    # a name that is a candidate itself (dbAccessPassword=) stays to be seen left of its value
    before = "if(n > 0 and length(_p[n]) <= 4, concat(_f[n - 1], _p[n]), _p[n])"
    return (t.withColumn("start", start)
            .select("key", "path", "n", "start", F.expr("substring(text, cast(start + 1 as int), length(value))").alias("value"),
                    F.expr(f"right({before}, {AROUND})").alias("left"), F.expr(f"left(_p[n + 1], {AROUND})").alias("right")))


def _share(value: str, kind: str) -> Column:
    return F.regexp_count(F.col(value), F.lit(kind)) / F.length(value)


def said_words(texts: DataFrame, hits: DataFrame, found: DataFrame) -> DataFrame:
    """(word, n): how often each run of two or more small letters stands in all ``texts``, of
    every row, outside the values of its candidates.  One pass counts all words; those inside
    values are taken off by the rows that have them."""
    runs = lambda c: F.explode(F.split(F.lower(F.col(c)), "[^a-z]+")).alias("word")
    rows = hits.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    inside = found.join(rows, "key").select((-F.col("rows")).alias("n"), runs("value"))
    # counted before the union, where a word of all texts is still a row for each of its places
    return (texts.select(runs("text")).filter("length(word) > 1").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .unionByName(inside.filter("length(word) > 1"))
            .groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0"))


def letter_transitions(words: DataFrame) -> Column:
    """Log-probabilities of the next letter, 26 x 26 in one constant array, add-one smoothed,
    from counted words (word, n)."""
    pairs = (words.select("n", F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substr(word, i, 2))")).alias("p"))
             .groupBy("p").agg(F.sum("n").alias("count")))
    count = {r["p"]: r["count"] for r in pairs.collect()}     # at most 26 * 26 rows
    import math
    letters = "abcdefghijklmnopqrstuvwxyz"
    out = []
    for a in letters:
        total = sum(count.get(a + b, 0) for b in letters)
        out += [math.log((count.get(a + b, 0) + 1) / (total + 26)) for b in letters]
    return F.from_json(F.lit(str(out)), "array<double>")


def featured(found: DataFrame, transitions: Column, dictionary: DataFrame) -> DataFrame:
    """Add the ``FEATURES`` columns to candidates (key, path, n, value, left, right)."""
    v = F.lower("value")
    mean = F.expr("""aggregate(
        filter(transform(sequence(1, greatest(length(_v) - 1, 1)), i -> substr(_v, i, 2)), p -> p rlike '^[a-z][a-z]$'),
        struct(0D AS s, 0 AS n),
        (a, p) -> struct(a.s + _t[(ascii(p) - 97) * 26 + ascii(substr(p, 2, 1)) - 97] AS s, a.n + 1 AS n),
        a -> CASE WHEN a.n > 0 THEN a.s / a.n ELSE -5D END)""")
    f = (found.withColumn("_v", v).withColumn("_t", transitions).withColumn("transition", mean).drop("_t")
         .withColumn("_runs", F.expr("filter(split(_v, '[^a-z]+'), r -> length(r) > 2)")))
    runs = f.select("key", "n", F.explode("_runs").alias("word"))
    known = (runs.join(dictionary, "word", "left_semi").groupBy("key", "n")
             .agg(F.sum(F.length("word")).alias("_known")))
    f = f.join(known, ["key", "n"], "left")
    left, near = F.coalesce("left", F.lit("")), F.concat_ws(" ", "left", "right")
    last = F.lower(F.regexp_extract(left, r"(\w+)\W*$", 1))
    as_int = lambda c: c.cast("int").cast("double")
    return (f.withColumn("length", F.length("value").cast("double"))
            .withColumn("digits", _share("value", "[0-9]")).withColumn("uppers", _share("value", "[A-Z]"))
            .withColumn("lowers", _share("value", "[a-z]")).withColumn("signs", _share("value", "[^A-Za-z0-9]"))
            .withColumn("changes", F.regexp_count("value", F.lit(
                r"(?<=[0-9])[^0-9]|(?<=[^0-9])[0-9]|(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]")) / F.length("value"))
            .withColumn("hex", as_int(F.col("value").rlike("^[0-9a-fA-F]+$")))
            .withColumn("kinds_seen", F.size(F.array_distinct(F.split("value", ""))) / F.length("value"))
            .withColumn("coverage", F.coalesce(F.col("_known") / F.length("value"), F.lit(0.0)))
            .withColumn("repeated", as_int(F.col("value").rlike(r"(.)\1{3}|(.{2,6})\2{2}")))
            .withColumn("path_hash", (F.pmod(F.xxhash64(F.coalesce("path", F.lit(""))), F.lit(16))).cast("double"))
            .withColumn("path_test", as_int(F.coalesce("path", F.lit("")).rlike(TEST_WORDS)))
            .withColumn("key_left", as_int(left.rlike(rf"{KEY_WORDS}([_\-]?key)?\W*((bearer|basic)\s+[\"']?)?$")))
            .withColumn("assigned", as_int(left.rlike(r"[:=]\s*[\"']?$")))
            .withColumn("quoted", as_int(left.rlike("[\"']$")))
            .withColumn("test_near", as_int(F.concat_ws(" ", "value", near).rlike(TEST_WORDS)))
            .withColumn("provider", as_int(F.col("value").rlike(PROVIDER)))
            .withColumn("left_hash", F.pmod(F.xxhash64(last), F.lit(64)).cast("double"))
            .withColumn("alone", as_int(left.rlike(r"(^|\s)$") & F.coalesce("right", F.lit("")).rlike(r"^(\s|$)")))
            .withColumn("in_url", as_int(left.rlike(_URL + "$") & F.coalesce("right", F.lit("")).startswith("@")))
            .drop("_v", "_runs", "_known"))


def told_findings(spark: SparkSession, rows: int = 8000) -> DataFrame:
    """A table of labelled findings made by rule from digests: (path, value, left, right,
    label)."""
    # A digest and its forms are columns, each made once; inside the kinds they would be written
    # out in every one of them, and the driver would compile a megabyte of code.
    conv = lambda k: F.conv(F.substring("h", k, 4), 16, 10).cast("int")
    said = F.split(F.lit("the and with for report value index order point state water house paper north"), " ")
    shown = F.split(F.lit("required optional incorrect disabled unknown string undefined password protected expired"), " ")
    d = spark.range(rows).select("id", (F.col("id") % 40).cast("int").alias("u"), F.sha2(F.concat(F.lit("k"), F.col("id").cast("string")), 512).alias("h"),
                                 (F.lit(16) + F.col("id") % 29).cast("int").alias("size"), (F.lit(6) + F.col("id") % 7).cast("int").alias("small"))
    d = d.select("*", F.translate("h", "0123456789", "ghijklmnop").alias("letters"), F.translate(F.base64(F.unhex("h")), "+/=", "xyz").alias("b64"),
                 F.concat(*[F.element_at(said, conv(1 + 4 * k) % 14 + 1) for k in range(5)]).alias("word"))
    spaced = F.regexp_replace("word", "(the|and|with|for|report|value|index|order|point|state|water|house|paper|north)", "$1 ")
    d = d.select("*", F.translate("b64", "0123456789", "qWxZvKjGyB").alias("mixed"), F.regexp_replace(F.initcap(spaced), " ", "").alias("title"))
    h, letters, b64, word, title, mixed, size, small = (F.col(c) for c in ("h", "letters", "b64", "word", "title", "mixed", "size", "small"))
    some = lambda c, n: F.substring(c, 1, n) if isinstance(n, int) else c.substr(F.lit(1), n)
    one = lambda k: F.element_at(shown, conv(k) % 10 + 1)
    kinds = [   # (value, left, right, label)
        (some(h, size), "password=", " then", 1), (some(b64, size), "api_key: \"", "\"", 1),
        (some(h, 40), "token = \"", "\" and", 1), (F.concat(F.lit("AKIA"), some(F.upper(F.translate(h, "0189", "MNPQ")), 16)), "with ", " for", 1),
        (some(b64, size), "secret='", "'", 1), (F.concat(F.lit("ghp_"), some(b64, 36)), "use ", " here", 1),
        (some(b64, size), "Authorization: Bearer ", "\n", 1), (some(h, 32), "pwd: ", "\n", 1),
        (F.concat(F.lit("AKIA"), some(F.upper(letters), 16)), "the ", " and", 1), (F.concat(F.lit("sk_live_"), some(b64, 24)), "key ", "", 1),
        (some(F.translate(h, "abcdef", "123456"), 16), "the card ", " on", 0), (F.upper(word), "AND ", " THE", 0),
        (F.concat(some(word, 14), F.lit("_v2")), "def ", "(", 0), (F.lit("xxxxxxxxxxxx1234"), "password=", " ", 0),
        (F.concat(F.lit("your-token-here-"), F.col("id").cast("string")), "token = \"", "\"", 0),
        (F.concat(F.lit("2024-01-02T03-04-"), F.col("id").cast("string")), "at ", " the", 0),
        (some(F.translate(h, "abcdef", "987654"), 13), "phone ", ", or", 0), (F.concat(some(word, 12), F.col("id").cast("string")), "see ", " in", 0),
        (some(h, 40), "commit ", " of", 0), (F.upper(some(word, 18)), "", ". THE", 0),
        # short values, signs, passphrases and URLs; whole runs of letters
        (some(b64, small), "password=", " ", 1), (F.concat(some(b64, 5), F.lit("!"), F.substring(h, 9, 4), F.lit("#")), "password: ", "\n", 1),
        (F.concat(some(h, 4), F.lit("@"), F.substring(b64, 9, 3), F.lit("$%")), "pwd=\"", "\"", 1), (some(letters, small), "secret: ", " and", 1),
        (F.concat(some(F.translate(word, "aeiou", "oaeiu"), 7), F.lit("-"), F.substring(letters, 1, 6), F.lit("-"), F.substring(letters, 9, 5)), "passphrase: ", "\n", 1),
        (some(F.translate(h, "abcdef", "123456"), small), "passwd=", " ", 1), (some(b64, small), "db://admin:", "@db.host/", 1),
        (F.concat(some(b64, 4), F.lit("&"), F.substring(b64, 7, 4), F.lit(".~")), "https://user:", "@site", 1),
        (some(letters, small), "amqp://svc:", "@queue", 1), (some(mixed, size), "key ", " the", 1), (some(mixed, size), "token: ", " ", 1),
        (some(mixed, small), "api_key='", "'", 1), (one(1), "password: ", " for", 0), (one(5), "token=", " ", 0), (one(9), "secret: ", ", ", 0),
        (F.concat(F.lit("${"), F.upper(some(word, 8)), F.lit("}")), "password=", " ", 0), (F.concat(F.lit("os.environ["), some(word, 6)), "secret = ", " ", 0),
        (F.lit("********"), "password: ", " ", 0), (some(title, 22), "call ", " for", 0), (F.concat(F.lit("get"), some(title, 16)), "the ", "(", 0)]
    u, value = F.col("u"), F
    for k, (v, _, _, _) in enumerate(kinds):
        value = value.when(u == k, v)
    of_kind = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in kinds]), u + 1)
    return d.select(
        F.concat(F.lit("told"), F.col("id").cast("string")).alias("key"), F.lit(0).alias("n"),
        F.concat(F.lit("path"), (F.col("id") % 7).cast("string")).alias("path"), value.alias("value"), of_kind(1).alias("left"),
        of_kind(2).alias("right"), of_kind(3).cast("double").alias("label"))


def rule_labels(f: DataFrame) -> DataFrame:
    """The candidates on which a strict rule is sure, with ``label``."""
    sure = ((F.col("provider") == 1) | ((F.col("key_left") == 1) & (F.col("assigned") == 1) & (F.col("kinds_seen") > 0.2)
                                        & (F.col("digits") > 0.05) & (F.col("lowers") + F.col("uppers") > 0.05)
                                        & (F.col("repeated") == 0)) & (F.col("test_near") == 0))
    never = (F.col("digits") == 1) & (F.col("assigned") == 0)
    return f.withColumn("label", F.when(sure, 1.0).when(never, 0.0)).filter("label is not null")


def dictionary(words: DataFrame) -> DataFrame:
    """Counted words (word, n) of three or more letters seen twice or more."""
    return words.filter("length(word) > 2 and n > 1").select("word")


def fit(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH) -> PipelineModel:
    """The forest, from all rows with ``FEATURES`` and ``label``, dealt by key into partitions
    of about ``FIT_ROWS`` in one order, so that the forest does not depend on how they came."""
    labelled = labelled.select("key", "n", *FEATURES, "label")
    rows = labelled.repartition(1 + labelled.count() // FIT_ROWS, "key").sortWithinPartitions("key", "n")
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", rawPredictionCol="_raw", predictionCol="_pred",
                                    probabilityCol="_prob", numTrees=trees, maxDepth=depth, seed=7)
    vector = VectorAssembler(inputCols=FEATURES, outputCol="_features", handleInvalid="keep")
    return PipelineModel([vector, forest.fit(vector.transform(rows))])


def judged(hits: DataFrame, said: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Rows of ``with_candidates`` with a key and a path, and all rows' (text) -> (key, n, start,
    value, score) of every candidate of every distinct text and path."""
    spark = hits.sparkSession
    texts = hits.groupBy("key").agg(*[F.first(c).alias(c) for c in ("path", "text", "marks")])
    found = candidates(texts).checkpoint()
    counted = said_words(said, hits, found).checkpoint()     # once, for both
    transitions, words = letter_transitions(counted), dictionary(counted)
    f = featured(found, transitions, words).checkpoint()
    if labelled is None:
        told = told_findings(spark).checkpoint()     # once, not once for each feature
        cols = ["key", "n", *FEATURES, "label"]
        labelled = featured(told, transitions, words).select(cols).union(rule_labels(f).select(cols)).checkpoint()
    model = fit(labelled)
    return model.transform(f).select("key", "n", "start", "value", F.round(vector_to_array("_prob")[1], 6).alias("score"))


def text_key(text: str, path: str) -> Column:
    return F.sha2(F.concat_ws("\0", F.coalesce(F.col(path).cast("string"), F.lit("")), F.col(text)), 256)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source",
         cut: float = CUT, **how) -> DataFrame:
    """One row for each candidate of each document: id, start and length in characters, the
    value's hash, its probability, and the verdict."""
    hits = with_candidates(docs, text_col, id=F.col(id_col), path=F.col(path_col).cast("string"),
                           key=text_key(text_col, path_col)).checkpoint()
    return hits.select("id", "key").join(judged(hits, docs.select(F.col(text_col).alias("text")), **how), "key").select(
        F.col("id").alias(id_col), "start", F.length("value").cast("long").alias("length"),
        F.sha2("value", 256).alias("value_sha256"), "score", (F.col("score") >= cut).alias("is_secret"))


def redact(docs: DataFrame, text_col: str = "text", path_col: str = "source", length_col: str | None = "n_chars",
           cut: float = CUT, **how) -> DataFrame:
    """The documents with every secret replaced by ``MASK``; the others pass untouched.  A
    row's columns are one struct meanwhile, so that no name of them can clash.  The texts are
    searched once; afterwards a text's digest tells whether it has secrets.  Their places are
    written first, so that Spark knows their size when it plans the join: few are broadcast."""
    spark, key = docs.sparkSession, text_key(text_col, path_col)
    hits = with_candidates(docs, text_col, path=F.col(path_col).cast("string"), key=key).checkpoint()
    spans = (judged(hits, docs.select(F.col(text_col).alias("text")), **how).filter(F.col("score") >= cut).groupBy("key")
             .agg(F.array_sort(F.collect_set(F.struct("start", F.length("value").alias("size")))).alias("spans")))
    path = scratch_path(spark, "spans")
    spans.write.parquet(path)
    new = F.expr(f"""aggregate(spans, struct('' AS done, 0L AS at),
        (a, s) -> struct(concat(a.done, substring(text, cast(a.at + 1 as int), cast(s.start - a.at as int)), '{MASK}') AS done,
                         s.start + s.size AS at),
        a -> concat(a.done, substring(text, cast(a.at + 1 as int))))""")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"), key.alias("key"))
    rows = rows.join(spark.read.parquet(path), "key", "left").withColumn("new", F.when(F.col("spans").isNotNull(), new))
    out = []
    for c in docs.columns:
        own = F.col("row").getField(c)
        if c == text_col:
            own = F.coalesce("new", own)
        elif c == length_col:
            own = F.coalesce(F.length("new").cast(docs.schema[c].dataType), own)
        out.append(own.alias(c))
    return rows.select(*out)
