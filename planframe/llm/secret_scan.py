"""Secret scans with a random forest that removes false positives.

Candidates are found by patterns: values assigned to secret-like names, provider keys, private key blocks, runs of letters
and digits, long runs of letters alone. Every place of a candidate is described by its length, its transitions
between letters, digits and cases, the share of it that dictionary words cover, the path it comes from and the
words next to it there; a random forest trained from labelled findings gives the probability that it is a secret. A value
is as secret as its most suspicious place in the document.

The dictionary is the corpus's own: its ``dictionary_words`` most frequent words of four letters or more, counted over all
documents. The forest is trained on at most ``train_rows`` labelled findings. ``labelled_findings`` makes such a
set by rule where no labelled one is at hand: real-looking secrets against placeholders, digests, identifiers, versions and long words, with
paths that go with the label.

DataFrame and spark.ml (JVM) operations only. One scan of the texts for the dictionary and one for the candidates; only candidates go
further, and only places of one value in one document meet in a group.

Defined results. Null or blank text: no findings. A value that a document repeats is one finding with its
number of places and the start of the most suspicious one (of equal ones, the first), whether it stands bare or assigned. Repeated rows: a finding each. Null
path: an empty path. Very long texts: whole. Empty table: no rows. Other columns, whatever their names, are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import fresh, materialise, text_or_empty

#: Names before an assigned secret, and prefixes of providers' keys.
NAMES = "password|passwd|pwd|secret|token|api_?key|access_?key|credential"
PREFIXES = "AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|xox[abp]-|sk-|AIza|eyJ"
#: Words that mark placeholders, and words that mark digests and identifiers.
PLACEHOLDERS = "example|sample|dummy|placeholder|changeme|your|test|fake|todo|xxx|redacted"
IDENTIFIERS = "sha1|sha256|md5|digest|checksum|commit|revision|uuid|guid|build|version|order|invoice|isbn|phone"
#: Parts of paths where findings are seldom real.
UNREAL = "test|example|sample|fixture|mock|docs?/"
#: Words for made findings where a corpus gives none.
PLAIN_WORDS = "that with this from have been they were their which there would about could other people".split()
KEY_BLOCK = r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[^-]+-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----"
ASSIGNED = rf"(?i:{NAMES})[\"']?\s{{0,8}}[:=]\s{{0,8}}[\"']?"
TOKEN = "A-Za-z0-9+/_\\-"
CANDIDATE = (
    rf"{KEY_BLOCK}|{ASSIGNED}(?:{KEY_BLOCK}|[^\s\"',;]{{6,}})"
    rf"|(?<![{TOKEN}])(?:(?:{PREFIXES})[{TOKEN}]{{8,}}|(?=[A-Za-z+/_\-]*+[0-9])[{TOKEN}]{{14,}}|[{TOKEN}]{{24,}})={{0,2}}"
)
FEATURES = ["length", "digit_share", "upper_share", "letter_digit", "case_turns", "distinct_share", "coverage", "hexadecimal", "prefix", "assigned", "near_name", "near_placeholder", "near_identifier", "path_unreal"]


@dataclass
class Model:
    forest: PipelineModel
    words: list[str]

    def importance(self) -> dict[str, float]:
        """How much each feature decides."""
        return dict(zip(FEATURES, self.forest.stages[-1].featureImportances.toArray().tolist()))


def dictionary(docs: DataFrame, dictionary_words: int = 1000) -> list[str]:
    """The most frequent words of ``docs`` of four letters or more, lower case; of equal counts the first by name."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text_or_empty(docs)), F.lit(r"\p{L}{4,}"), F.lit(0))).alias("word"))
    return [r[0] for r in words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(dictionary_words).collect()]


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("double")


def describe(found: DataFrame, words: list[str]) -> DataFrame:
    """Adds FEATURES to columns value, assigned_name, before, after, path. ``words``: letters only."""
    v, n = F.col("value"), F.greatest(F.length("value"), F.lit(1)).cast("double")
    known = "|".join(sorted(set(words or PLAIN_WORDS), key=lambda w: (-len(w), w)))
    around = F.concat_ws(" ", "before", "assigned_name", "after")
    return found.select(
        "*",
        F.length(v).cast("double").alias("length"),
        (_count(v, "[0-9]") / n).alias("digit_share"),
        (_count(v, "[A-Z]") / n).alias("upper_share"),
        (_count(v, "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])") / n).alias("letter_digit"),
        (_count(v, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])") / n).alias("case_turns"),
        (F.size(F.array_distinct(F.split(v, ""))).cast("double") / n).alias("distinct_share"),
        (1 - F.length(F.regexp_replace(F.lower(v), known, "")) / n).alias("coverage"),
        _flag(v.rlike("^[0-9a-fA-F]+$")).alias("hexadecimal"),
        _flag(v.rlike(f"^(?:{PREFIXES}|-----BEGIN )")).alias("prefix"),
        _flag(F.length("assigned_name") > 0).alias("assigned"),
        _flag(around.rlike(f"(?i)(?:{NAMES})")).alias("near_name"),
        _flag(F.concat_ws(" ", around, v).rlike(f"(?i)(?:{PLACEHOLDERS})")).alias("near_placeholder"),
        _flag(around.rlike(f"(?i)(?:{IDENTIFIERS})")).alias("near_identifier"),
        _flag(F.col("path").rlike(f"(?i)(?:{UNREAL})")).alias("path_unreal"),
    )


def candidates(docs: DataFrame, path: str = "source", reach: int = 48) -> DataFrame:
    """A row a place: row_id, doc_id, path, value, assigned_name, start (characters from 0), before, after."""
    text = text_or_empty(docs)
    where = F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    each = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id"), where.alias("path"), text.alias("text"))
    # the places of matches follow from the lengths of the matches and of the gaps before them
    some = each.filter(F.col("text").rlike(CANDIDATE)).select("*", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("all"), F.split("text", CANDIDATE, -1).alias("gaps"))
    steps = F.transform("all", lambda hit, i: F.struct(hit.alias("hit"), F.length(F.get("gaps", i)).alias("gap")))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<hit: string, at: int>>").alias("out"))
    add = lambda acc, x: F.struct((acc["at"] + x["gap"] + F.length(x["hit"])).alias("at"), F.concat(acc["out"], F.array(F.struct(x["hit"].alias("hit"), (acc["at"] + x["gap"]).alias("at")))).alias("out"))
    one = some.select("row_id", "doc_id", "path", "text", F.inline(F.aggregate(steps, none, add, lambda acc: acc["out"])))
    name = F.regexp_extract("hit", rf"^({ASSIGNED})", 1)
    at = F.col("at") + 1
    return one.select(
        "row_id", "doc_id", "path",
        F.substring(F.col("hit"), F.length(name) + 1, F.length("hit")).alias("value"),
        name.alias("assigned_name"),
        (F.col("at") + F.length(name)).cast("long").alias("start"),
        F.substring(F.col("text"), F.greatest(F.lit(1), at - reach), F.least(F.lit(reach), F.col("at"))).alias("before"),
        F.substring(F.col("text"), at + F.length("hit"), F.lit(reach)).alias("after"),
    )


def labelled_findings(spark: SparkSession, words: list[str] | None = None, rows: int = 6000, seed: int = 7) -> DataFrame:
    """value, assigned_name, before, after, path, is_secret: ``rows`` findings made by rule from hashes of their numbers, amid ``words``."""
    words = words or PLAIN_WORDS
    h = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(1 << 30))
    digest = F.sha2(F.concat_ws("/", F.lit(seed), F.col("id").cast("string")).cast("binary"), 512)
    upper = F.upper(F.translate(digest, "0123456789abcdef", "q7w2e4rt5yu3ip6k"))
    both = F.translate(F.base64(F.unhex(digest)), "+/=", "xY")
    letters = F.regexp_replace(both, "[0-9]", "")
    vocabulary = F.split(F.lit(" ".join(words)), " ")
    word = lambda k: F.get(vocabulary, F.pmod(h(k), F.lit(len(words))).cast("int"))
    filler = lambda k: F.concat_ws(" ", *[word(k + i) for i in range(5)])
    long_word = F.concat(*[word(100 + i) for i in range(5)])
    names = F.array(*[F.lit(x) for x in ("password=", 'token = "', "secret: ", "api_key=", "pwd=")])
    some_name = F.get(names, F.pmod(h(3), F.lit(5)).cast("int"))
    size = F.lit(16) + F.pmod(h(4), F.lit(25)).cast("int")
    cases = [  # value, assigned name, word before, is_secret
        (F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), "", "", 1),
        (F.substring(digest, F.lit(1), size), some_name, "", 1),
        (F.substring(digest, F.lit(1), F.lit(40)), 'token = "', "", 1),
        (F.substring(digest, F.lit(1), F.lit(18)), "password=", "", 1),
        (F.substring(both, F.lit(1), size), some_name, "", 1),
        (F.concat(F.lit("ghp_"), F.substring(both, 1, 36)), "", "", 1),
        (F.substring(both, F.lit(1), F.lit(40)), "", "aws secret ", 1),
        (F.substring(letters, F.lit(1), F.lit(32)), "", "secret ", 1),
        (F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), both, F.lit("\n-----END RSA PRIVATE KEY-----")), "", "", 1),
        (F.concat(F.lit("AKIA"), F.substring(upper, 1, 9), F.lit("EXAMPLE")), "", "", 0),
        (F.lit("changeme123"), some_name, "", 0),
        (F.concat(F.lit("your_"), word(7), F.lit("_token_123")), some_name, "", 0),
        (F.substring(digest, F.lit(1), F.when(h(8) % 2 == 0, 40).otherwise(64)), "", F.when(h(9) % 2 == 0, "commit ").otherwise("sha256 "), 0),
        (F.concat(long_word, F.when(h(10) % 2 == 0, F.pmod(h(10), F.lit(100)).cast("string")).otherwise("")), "", "", 0),
        (F.concat_ws("-", F.lit("build"), F.pmod(h(11), F.lit(2000)).cast("string"), F.pmod(h(12), F.lit(99999999)).cast("string")), "", "version ", 0),
        (F.concat(*[F.pmod(h(13 + i), F.lit(10)).cast("string") for i in range(16)]), "", F.when(h(40) % 2 == 0, "order ").otherwise(""), 0),
        (F.substring(digest, F.lit(1), F.lit(40)), some_name, "", 0),  # a key of a test: told from a real one by its path alone
    ]
    kind = F.pmod(h(5), F.lit(len(cases)))
    pick = lambda i: F.coalesce(*[F.when(kind == k, case[i] if isinstance(case[i], Column) else F.lit(case[i])) for k, case in enumerate(cases)])
    unreal = (kind == len(cases) - 1) | (F.pmod(h(60), F.lit(100)) < F.when(pick(3) == 1, 2).otherwise(40))
    folders = F.when(unreal, F.get(F.array(*[F.lit(x) for x in ("tests/", "docs/", "examples/", "fixtures/")]), F.pmod(h(61), F.lit(4)).cast("int"))).otherwise(F.get(F.array(*[F.lit(x) for x in ("src", "app/", "config/", "")]), F.pmod(h(61), F.lit(4)).cast("int")))
    base = spark.range(0, rows, 1, 4)
    return base.select(pick(0).alias("value"), pick(1).alias("assigned_name"), F.concat(filler(200), F.lit(" "), pick(2)).alias("before"), F.concat(F.lit(" "), filler(300)).alias("after"), F.concat(folders, h(50).cast("string")).alias("path"), pick(3).cast("int").alias("is_secret"))


def train(findings: DataFrame, words: list[str] | None = None, train_rows: int = 20_000, trees: int = 24, depth: int = 8, seed: int = 11) -> Model:
    """A forest over FEATURES; ``findings`` as from ``labelled_findings``, of which those of least hash are used; ``words``: the dictionary."""
    words = words or PLAIN_WORDS
    given = findings.filter("value is not null and is_secret is not null")
    labelled = materialise(given.orderBy(F.xxhash64(*given.columns)).limit(train_rows))
    bounded = describe(labelled, words).withColumn("label", F.col("is_secret").cast("double")).select("label", *FEATURES)
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=2)
    return Model(PipelineModel([assemble, forest.fit(assemble.transform(bounded))]), words)


def scan(docs: DataFrame, model: Model, path: str = "source", threshold: float = 0.5) -> DataFrame:
    """doc_id, path, value, assigned_name, start, occurrences, probability, is_secret: a row for each value of each row of ``docs``."""
    judged = model.forest.transform(describe(candidates(docs, path), model.words))
    places = judged.select("row_id", "doc_id", "path", "value", "assigned_name", "start", F.round(vector_to_array("probability")[1], 6).alias("probability"))
    best = F.min(F.struct((-F.col("probability")).alias("p"), "start", "assigned_name", "doc_id", "path")).alias("best")
    found = places.groupBy("row_id", "value").agg(F.count("*").cast("long").alias("occurrences"), best)
    p = -F.col("best.p")
    return found.select("best.doc_id", "best.path", "value", "best.assigned_name", "best.start", "occurrences", p.alias("probability"), (p >= threshold).alias("is_secret"))


def redact(docs: DataFrame, model: Model, path: str = "source", threshold: float = 0.5, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every place of every secret's value replaced by ``mask``, in one pass, longer values before shorter ones."""
    row_id, row_key, values = fresh(docs.columns, "row_id", "row_key", "secret_values")
    text = F.xxhash64(text_or_empty(docs))
    named = docs.select(F.struct(F.col("doc_id"), text.alias("k")).alias("doc_id"), F.col("text"), *([F.col(path)] if path in docs.columns and path not in ("doc_id", "text") else []))
    found = scan(named, model, path, threshold).filter("is_secret")
    longest = F.array_sort(F.collect_set(F.struct((-F.length("value")).alias("n"), "value")))
    quoted = F.transform(longest, lambda v: F.concat(F.lit(r"\Q"), F.replace(v["value"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E")))
    each = found.groupBy("doc_id").agg(F.array_join(quoted, "|").alias(values)).select(F.col("doc_id.doc_id").alias(row_id), F.col("doc_id.k").alias(row_key), values)
    joined = docs.join(each, F.col("doc_id").eqNullSafe(F.col(row_id)) & (text == F.col(row_key)), "left")
    safe = mask.replace("\\", "\\\\").replace("$", "\\$")
    clean = F.when(F.col(values).isNull(), F.col("text").cast("string")).otherwise(F.regexp_replace(F.col("text").cast("string"), F.col(values), F.lit(safe)))
    return joined.select(*[clean.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
