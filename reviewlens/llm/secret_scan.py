"""Secret scan: candidate strings, and a random forest that removes false positives.

A regular expression proposes candidates; a forest trained from labelled
findings decides by their length, characters, character transitions, coverage
by dictionary words, path and neighbouring words. DataFrame expressions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import checkpointed

CONTEXT = 80
DICTIONARY_SLOTS = 1 << 15
DICTIONARY_SHARE = 0.01
MAX_ROWS = 1_500
THRESHOLD = 0.5
MARK = "[SECRET]"
# What a candidate looks like, and the words around true and false findings.
_RUN = r"A-Za-z0-9+/_\-"
CANDIDATE = (rf"(?<![{_RUN}])(?:(?=[A-Za-z+/_\-]*[0-9])[{_RUN}]{{16,}}"
             rf"|(?<=[=:]\s{{0,2}}[\"'])[A-Za-z+/_\-]{{16,}})={{0,2}}")
CREDENTIAL = r"(?i)(token|secret|passw(or)?d|pwd|api[_\- ]?key|access[_\- ]?key|auth|bearer|credential|private[_\- ]?key)"
ASSIGNED = r"(?i)(token|secret|passw(or)?d|pwd|key|auth|bearer|credentials?)[\"']?\s*(=|:|=>|:=|\s)\s*[\"']?$"
REFERENCE = r"(?i)(sha-?\d*|md5|commit|checksum|digest|hash|uuid|revision|etag|version|id|build)[\"']?\s*[=:#]?\s*[\"']?$"
PLACEHOLDER = r"(?i)(example|sample|dummy|placeholder|changeme|your[_\-]|_here|xxxx|test[_\-]|fake|0123456789|1234567)"
PREFIX = r"^(AKIA|ASIA|gh[pousr]_|github_pat_|xox[abprs]-|sk_live_|sk-|AIza|glpat-|eyJ)"
TEST_PATH = r"(?i)(test|spec|example|sample|fixture|mock|docs?/|\.lock$|\.min\.)"
CONFIG_PATH = r"(?i)(\.env|config|settings|secret|credential|\.pem|\.ya?ml$|\.tf$|\.properties$)"

# Paths of labelled findings.
CONFIG_PATHS = (".env", "config/app.yaml", "deploy/main.tf", "settings.py", "keys/server.pem", "app.properties")
TEST_PATHS = ("tests/test_app.py", "docs/guide.md", "poetry.lock", "spec/app_spec.rb", "examples/run.sh", "site.min.js")


def candidates(docs: DataFrame, path_col: str | None = "source") -> DataFrame:
    """(doc_id, start, value, left, right, path) of every candidate in the whole texts.

    ``start`` counts code points. ``left`` and ``right`` are the ``CONTEXT``
    code points beside it, up to the next candidate. Null and empty texts
    have none; repeated rows give their findings again.
    """
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col in docs.columns else F.lit("")
    texts = docs.select("doc_id", path.alias("path"), "text").withColumn(
        "values", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).filter(F.size("values") > 0)
    cut = texts.withColumn("between", F.split("text", CANDIDATE, -1))
    sizes = F.transform("values", lambda v, i: F.char_length(F.get("between", i)) + F.char_length(v))
    ends = F.aggregate(sizes, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    found = F.transform("values", lambda v, i: F.struct(
        v.alias("value"), F.right(F.get("between", i), F.lit(CONTEXT)).alias("left"),
        F.left(F.get("between", i + 1), F.lit(CONTEXT)).alias("right"),
        (F.get("ends", i + 1) - F.char_length(v)).alias("start")))
    return (cut.withColumn("ends", ends).select("doc_id", "path", F.explode(found).alias("f"))
            .select("doc_id", "f.start", "f.value", "f.left", "f.right", "path"))


def _sampled(docs: DataFrame, path: Column, max_rows: int) -> DataFrame:
    """(text, path) of the ``max_rows`` distinct texts with the least hashes; of copies the least path.

    The hashes are ranked first, without the texts, so only the sample moves.
    """
    rows = docs.filter("text is not null").select("text", path.alias("path"), F.xxhash64("text").alias("h"))
    bound = rows.select("h").distinct().orderBy("h").limit(max_rows).agg(F.max("h")).first()[0]
    few = rows.filter(F.col("h") <= bound) if bound is not None else rows.limit(0)
    return few.groupBy("text").agg(F.min("path").alias("path"))


def labelled_findings(docs: DataFrame, max_rows: int = MAX_ROWS, path_col: str | None = "source") -> DataFrame:
    """(value, left, right, path, label): findings labelled by rule, derived from at most ``max_rows`` texts.

    From each sampled text (in the order of its hash) come true findings -
    random-looking strings in credential assignments - and the usual false
    ones: references, numbers, identifiers, paths, placeholders. Random parts
    are hashes of the text, words are the text's own. The text's own
    candidates are added where the rule is plain: a mixed value assigned to a
    credential is true, a number outside an assignment is false. Half of the
    derived findings have the text's own path; of the others, true ones have
    a path of ``CONFIG_PATHS`` three times as often as one of ``TEST_PATHS``,
    and false ones the reverse, by a hash of the text. A random string that
    no word explains is true in configuration and false elsewhere.
    """
    given = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col in docs.columns else F.lit("")
    sample = checkpointed(_sampled(docs, given, max_rows))
    w = lambda i: F.coalesce(F.get("w", F.lit(i)), F.lit("word"))
    hexa, raw = F.sha2("text", 256), F.base64(F.unhex(F.concat(F.sha2("text", 256), F.md5("text"))))
    mixed = F.translate(raw, "+/=", "aZ9")
    digits = F.translate(hexa, "abcdef", "012345")
    near = F.concat_ws(" ", w(0), w(1))
    spaced = lambda *x: F.concat(near, F.lit(" "), *[F.lit(v) if isinstance(v, str) else v for v in x])
    yes, no = F.lit(1), F.lit(0)
    kinds = [  # value, left, right, label
        (F.substring(hexa, 1, 48), spaced("secret = '"), F.concat(F.lit("' "), w(2)), yes),
        (F.upper(F.substring(hexa, 2, 32)), F.upper(spaced('access_key: "')), F.concat(F.lit('", '), w(2)), yes),
        (F.substring(hexa, 7, 24), spaced('"auth_token": "'), F.lit('"}'), yes),
        (F.substring(hexa, 5, 32), spaced("api_key: "), F.concat(F.lit("\n"), w(3)), yes),
        (F.substring(mixed, 1, 20), spaced("password="), F.concat(F.lit(" "), w(2)), yes),
        (F.substring(mixed, 3, 43), spaced("Authorization: Bearer "), F.concat(F.lit("\n"), w(3)), yes),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(mixed, 9, 16))), spaced("aws_access_key_id = "), F.lit("\n"), yes),
        (F.concat(F.lit("ghp_"), F.substring(mixed, 11, 36)), near, F.concat(F.lit(" "), w(2)), yes),
        (F.substring(raw, 1, 40), spaced("client_secret: '"), F.lit("'\n"), yes),
        (F.substring(digits, 1, 16), spaced(""), F.concat(F.lit(" "), w(2)), no),
        (F.substring(digits, 3, 20), spaced("number "), F.concat(F.lit(". "), w(2)), no),
        (F.substring(hexa, 1, 40), spaced("commit "), F.concat(F.lit(" "), w(2)), no),
        (hexa, spaced("sha256: "), F.lit("\n"), no),
        (F.md5("text"), spaced('checksum = "'), F.lit('"'), no),
        (F.concat_ws("-", F.substring(hexa, 1, 8), F.substring(hexa, 9, 4), F.substring(hexa, 13, 4),
                     F.substring(hexa, 17, 4), F.substring(hexa, 21, 12)), spaced("id "), F.concat(F.lit(" "), w(3)), no),
        (F.concat_ws("_", w(2), w(3), w(4), w(5), F.lit("2024")), spaced(""), F.concat(F.lit(" = "), w(1)), no),
        (F.concat(F.lit("/"), F.concat_ws("/", w(2), w(3), w(4), F.lit("v2"), w(5))), spaced("path "), F.lit(" "), no),
        (F.concat_ws("-", w(2), w(3), w(4), w(5), F.lit("12")), spaced("token = "), F.lit("\n"), no),
        (F.concat(F.lit("your_"), w(2), F.lit("_token_here1")), spaced('token = "'), F.lit('"'), no),
        (F.lit("xxxxxxxxxxxxxxxxxxxx1"), spaced("api_key = "), F.lit("\n"), no),
        (F.concat_ws("_", w(2), w(3), w(4), w(5)), spaced('password = "'), F.lit('"'), no),
    ]
    words = F.filter(F.split("text", r"[^A-Za-z]+"), lambda x: F.length(x).between(3, 12))

    bare = [(F.substring(hexa, 9 + 8 * k, 24 + 8 * k), spaced("value "), F.concat(F.lit(" "), w(2)), y)
            for k in (0, 1, 2) for y in (yes, no)]

    def path(kind: int, label: Column) -> Column:
        turn = lambda n: F.pmod(F.xxhash64(F.lit(kind), F.lit(n), "text"), F.lit(n)).cast("int")
        config, test = (F.get(F.array(*map(F.lit, p)), turn(len(p))) for p in (CONFIG_PATHS, TEST_PATHS))
        usual, other = F.when(label == 1, config).otherwise(test), F.when(label == 1, test).otherwise(config)
        if kind >= len(kinds):
            return F.when((label == 0) & (turn(8) < 4), F.col("path")).otherwise(usual)
        return F.when(turn(8) < 4, F.col("path")).when(turn(8) < 7, usual).otherwise(other)

    rows = sample.withColumn("w", words).select(F.explode(F.array(*[
        F.struct(v.alias("value"), left.alias("left"), right.alias("right"), path(k, y).alias("path"), y.alias("label"))
        for k, (v, left, right, y) in enumerate(kinds + bare)])).alias("f")).select("f.*")
    own = candidates(sample.withColumn("doc_id", F.lit(0)), "path").withColumn(
        "label", F.when(F.col("left").rlike(ASSIGNED) & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Fa-f]")
                        & ~F.col("value").rlike(PLACEHOLDER), yes)
        .when(F.col("value").rlike("^[0-9]+$") & ~F.col("left").rlike(ASSIGNED), no)).filter("label is not null")
    return rows.unionByName(own.select("value", "left", "right", "path", "label"))


@dataclass
class Scanner:
    """A fitted forest with its character transitions and dictionary."""

    forest: RandomForestClassificationModel | None
    transitions: list[float]
    dictionary: bytes


def _word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): in how many of all texts each word stands; counted per task before anything moves."""
    words = F.array_distinct(F.split(F.lower("text"), r"[^a-z]+"))
    return docs.select(F.explode(words).alias("word")).filter(F.length("word").between(2, 20)).groupBy("word").agg(
        F.count("*").alias("n"))


def _transitions(words: DataFrame) -> list[float]:
    """ln of how likely a letter follows another in the corpus's words, for 26 x 26 letters, smoothed."""
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(
        F.col("word"), i, F.lit(2)))).alias("pair")).groupBy("pair").count().collect()  # 676 rows at most
    n = {r["pair"]: r["count"] for r in pairs}
    letters = "abcdefghijklmnopqrstuvwxyz"
    total = {a: sum(n.get(a + b, 0) for b in letters) for a in letters}
    return [math.log((n.get(a + b, 0) + 0.5) / (total[a] + 13)) for a in letters for b in letters]


def _slots(word: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed), word), F.lit(DICTIONARY_SLOTS)) for seed in (1, 2)]


def _dictionary(words: DataFrame, texts: int) -> bytes:
    """A Bloom filter of the words that a share of all ``texts`` have: one byte per slot, so fixed in size."""
    kept = words.filter((F.col("n") >= max(2, DICTIONARY_SHARE * texts)) & (F.length("word") >= 3))
    slots = kept.select(F.explode(F.array(*_slots(F.col("word")))).alias("s")).distinct().collect()
    table = bytearray(DICTIONARY_SLOTS)
    for r in slots:
        table[r["s"]] = 1
    return bytes(table)


def features(found: DataFrame, transitions: list[float], dictionary: bytes) -> DataFrame:
    """``found`` with ``features`` (array of double) for the forest."""
    v, n = F.col("value"), F.length("value").cast("double")
    share = lambda pattern: F.length(F.regexp_replace(v, pattern, "")) / n
    chars = F.split(v, "")
    entropy = F.aggregate(F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / n),
                          F.lit(0.0), lambda a, p: a - p * F.log2(p))
    low = F.lower(v)
    steps = F.array(*[F.lit(t) for t in transitions])
    code = lambda i: F.ascii(F.substring(low, i, F.lit(1))) - 97
    follows = F.transform(F.sequence(F.lit(1), F.length(v) - 1), lambda i: F.when(
        code(i).between(0, 25) & code(i + 1).between(0, 25), F.get(steps, code(i) * 26 + code(i + 1))).otherwise(F.lit(-6.0)))
    transition = F.aggregate(follows, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(follows), F.lit(1))
    runs = F.filter(F.split(low, "[^a-z]+"), lambda r: F.length(r) >= 3)
    covered = F.aggregate(F.transform(runs, lambda r: F.when(_known(r, dictionary), F.length(r)).otherwise(0)), F.lit(0), lambda a, x: a + x) / n
    flag = lambda column, pattern: column.rlike(pattern).cast("double")
    switches = F.size(F.split(v, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")) / n
    left, right, path = (F.coalesce(c, F.lit("")) for c in ("left", "right", "path"))
    columns = [
        F.least(n, F.lit(200.0)), share("[^0-9]"), share("[^A-Z]"), share("[^a-z]"), share("[^+/_\\-]"),
        F.size(F.array_distinct(chars)) / n, entropy, transition, covered, switches,
        flag(v, "^[0-9]+$"), flag(v, "(?i)^[0-9a-f]+$"), flag(v, PREFIX), flag(v, PLACEHOLDER), flag(v, "^[A-Za-z]+([_\\-/][A-Za-z0-9]+)+$"),
        flag(left, ASSIGNED), flag(left, CREDENTIAL), flag(left, REFERENCE), flag(left, "[\"']$"), flag(right, "^[\"']"),
        flag(left, "\\S$"), flag(F.concat(left, right), PLACEHOLDER), flag(path, TEST_PATH), flag(path, CONFIG_PATH)]
    return found.withColumn("features", F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns]))


def _known(word: Column, dictionary: bytes) -> Column:
    table = F.lit(bytearray(dictionary))
    first, second = (F.substring(table, (s + 1).cast("int"), F.lit(1)) == F.lit(bytearray(b"\x01")) for s in _slots(word))
    return first & second


def train(findings: DataFrame, docs: DataFrame, trees: int = 30, depth: int = 8) -> Scanner:
    """Fit the forest on labelled findings; transitions and dictionary come from the words of all ``docs``.

    Null texts have no words; copies count as often as they come.

    Without true and false findings there is no forest, and nothing is a secret.
    """
    words = checkpointed(_word_counts(docs))
    transitions, dictionary = _transitions(words), _dictionary(words, docs.filter("text is not null").count())
    rows = checkpointed(features(findings, transitions, dictionary).select(
        array_to_vector("features").alias("vector"), F.col("label").cast("double").alias("label")))
    if rows.agg(F.countDistinct("label")).first()[0] < 2:
        return Scanner(None, transitions, dictionary)
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=depth, seed=17)
    return Scanner(forest.fit(rows), transitions, dictionary)


def scan(docs: DataFrame, scanner: Scanner, threshold: float = THRESHOLD, path_col: str | None = "source") -> DataFrame:
    """``candidates`` of all texts with the forest's ``score`` (0 to 1) and ``is_secret``."""
    found = candidates(docs, path_col)
    if scanner.forest is None:
        scored = found.withColumn("score", F.lit(0.0))
    else:
        vectors = features(found, scanner.transitions, scanner.dictionary).withColumn("vector", array_to_vector("features"))
        scored = scanner.forest.transform(vectors).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return (scored.withColumn("is_secret", F.col("score") >= threshold)
            .select("doc_id", "start", "value", "left", "right", "path", "score", "is_secret"))


def redact(docs: DataFrame, scanner: Scanner, threshold: float = THRESHOLD, path_col: str | None = "source") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``MARK``; n_chars, if there, is that of the new text.

    All documents stay. A value found to be a secret anywhere in a document is
    replaced wherever that document has it; rows that share a doc_id, or have
    none, count as one document for this. Only documents with a candidate are
    joined to their findings.
    """
    has = F.coalesce(F.col("text").rlike(CANDIDATE), F.lit(False))
    secrets = (scan(docs, scanner, threshold, path_col).filter("is_secret").groupBy("doc_id")
               .agg(F.array_sort(F.collect_set("value"), lambda a, b: F.length(b) - F.length(a)).alias("secrets")))
    named = docs.filter(has).alias("d").join(secrets.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")), "left")
    text = F.aggregate(F.coalesce("s.secrets", F.array().cast("array<string>")), F.col("d.text"),
                       lambda t, value: F.replace(t, value, F.lit(MARK)))
    size = F.char_length(text)
    columns = [text.alias(c) if c == "text" else F.when(F.col("s.secrets").isNull(), F.col("d.n_chars")).otherwise(
        size).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"d.`{c}`") for c in docs.columns]
    return docs.filter(~has).union(named.select(*columns))
