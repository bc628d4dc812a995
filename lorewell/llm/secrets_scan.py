"""Secret scan with a random forest that removes false positives (operator 1).

DataFrame and SQL functions only: candidates, features, training and scoring all run in the JVM.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that a secret is given under.
NAMES = r"token|secret|passw(?:or)?d|passphrase|pwd|api[_\-]?key|access[_\-]?key|auth|credential|private[_\-]?key"
#: What stands ahead of a named value: a name that holds one of NAMES and an assignment with any blanks, or the word of an HTTP header.
NAMED = rf"(?:[\w\-]{{0,40}}?(?i:{NAMES})[\w\-]{{0,20}}[\"']?\s*+[:=]{{1,2}}>?\s*+|(?i:bearer)\s++)(?:(?i:bearer|basic)\s++)?"
#: Ahead of the password of a URL: scheme and user.
URL = r"[A-Za-z][A-Za-z0-9+.\-]{1,15}://[^\s/:@\"'<>]{0,64}:"
#: A value in quotes goes on to its own kind of quote, within its line; one without ends at a blank, quote, comma or the like.
QUOTED = r"\"[^\"\n\r]{6,}+(?=\")|'[^'\n\r]{6,}+(?=')"
VALUE = r"[^\s\"'<>,;]{6,}+"
#: A candidate is any value of six characters or more under a name, the password of a URL, a token of three dotted parts, or a run of 16
#: token characters or more that is not letters of one case alone, as long words of prose are. Values of fewer than six characters, words
#: of one case and runs of fewer than 16 characters that have no name ahead of them are not looked at; a user name of over 64 characters,
#: or a name of over 60 around one of NAMES, is none.
DOTTED = r"[A-Za-z0-9_\-]{10,}+\.[A-Za-z0-9_\-]{10,}+\.[A-Za-z0-9_\-]{10,}+"
RUN = r"(?![a-z]++(?![A-Za-z0-9_+/=\-])|[A-Z]?[a-z]++(?![A-Za-z0-9_+/=\-])|[A-Z]++(?![A-Za-z0-9_+/=\-])|[_+/=\-]++(?![A-Za-z0-9_+/=\-]))[A-Za-z0-9_+/=\-]{16,}+"
PASSWORD = r"[^\s/@\"'<>]{3,}+(?=@)"
CANDIDATE = rf"(?<![A-Za-z0-9_+/=\-])(?:{NAMED}(?:{QUOTED}|[\"']?{VALUE})|{URL}{PASSWORD}|{DOTTED}|{RUN})"
#: What of a candidate's match stands ahead of its value.
AHEAD = rf"^(?:{NAMED}[\"']?(?=[^\n]{{6,}}\z)|{URL})"
#: Characters of context kept on either side.
NEAR = 48
#: Findings that the forest is trained on, trees, depth.
FINDINGS, TREES, DEPTH = 6_000, 24, 8
THRESHOLD = 0.5

# Words that code and prose are made of, for dictionary coverage.
WORDS = """account address admin alpha apache array author base beta body build bytes cache change class client code column
commit config connect content copyright count create data date debug default delete document domain error event example
export field file filter first format function global group handler hash header home host html http image import index input
install item java json label last left length level library license link list local login main master message method model module
name node number object option output package page path pattern point print process project public python query record
release report request result return right role root sample schema script search section select server service session setting
shared size source spark start state static status stream string style system table target temp test text thread time title
token total type unit update upload user value version view width window word write""".split()

# Neighbouring words that speak for and against a secret, and paths of tests and the like.
FOR = r"(?i)(token|secret|passw(or)?d|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential|private)\W{0,8}$"
ASSIGNED = r"[=:]\s*[\"']?$"
AGAINST = r"(?i)(example|sample|dummy|placeholder|changeme|test|fake|sha\d*|md5|commit|checksum|digest|hash|uuid|revision|etag|version|isbn|order|invoice|phone|card|id)\W{0,8}$"
TEST_PATH = r"(?i)(test|spec|fixture|example|sample|mock|doc|vendor|node_modules|lock)"

FEATURES = ["length", "transitions", "distinct", "entropy", "digits", "uppers", "lowers", "symbols", "hexlike", "dictionary", "repeats", "for_word", "assigned", "against_word", "test_path", "quoted"]


def _hits(c: Column, pattern: str) -> Column:
    """How much of c a pattern leaves out when it is removed."""
    return F.char_length(c) - F.char_length(F.regexp_replace(c, pattern, ""))


def features(found: DataFrame) -> DataFrame:
    """Adds FEATURES to findings with candidate, before, after and path; null contexts and paths count as empty."""
    c, n = F.col("candidate"), F.char_length("candidate").cast("double")
    chars = F.split(c, "")
    counts = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)) / n)
    steps = r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"
    before, after, path = (F.coalesce(F.col(x), F.lit("")) for x in ("before", "after", "path"))
    words = "|".join(sorted(WORDS, key=lambda w: (-len(w), w)))
    return found.withColumns(
        {
            "length": F.least(n, F.lit(200.0)),
            "transitions": (F.size(F.split(c, steps)) - 1) / n,
            "distinct": F.size(F.array_distinct(chars)) / n,
            "entropy": F.aggregate(counts, F.lit(0.0), lambda s, p: s - p * F.log2(p)),
            "digits": _hits(c, "[0-9]") / n,
            "uppers": _hits(c, "[A-Z]") / n,
            "lowers": _hits(c, "[a-z]") / n,
            "symbols": _hits(c, "[^A-Za-z0-9]") / n,
            "hexlike": c.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
            "dictionary": _hits(F.lower(c), words) / n,
            "repeats": _hits(c, r"(.)\1{2,}|(..+?)\2{2,}") / n,
            "for_word": before.rlike(FOR).cast("double"),
            "assigned": before.rlike(ASSIGNED).cast("double"),
            "against_word": before.rlike(AGAINST).cast("double"),
            "test_path": path.rlike(TEST_PATH).cast("double"),
            "quoted": (before.rlike("[\"']$") & after.rlike("^[\"']")).cast("double"),
        }
    )


def candidates(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, nth, candidate, before, after, path): every candidate of whole texts with what stands next to it.

    nth counts the candidates of a text from 0. Null and empty texts, and texts without a candidate, give no row. Repeated rows give
    repeated findings, and other columns of docs have no part in it.
    """
    rows = docs.select("doc_id", (F.col(path) if path else F.lit(None).cast("string")).alias("path"), "text").where(F.col("text").rlike(CANDIDATE))
    split = rows.select("doc_id", "path", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("c"), F.transform(F.split("text", CANDIDATE, -1), lambda s: F.struct(F.right(s, F.lit(NEAR)).alias("r"), F.left(s, F.lit(NEAR)).alias("l"))).alias("s"))
    each = split.select("doc_id", "path", "s", F.posexplode("c").alias("nth", "m")).withColumn("name", F.regexp_extract("m", AHEAD, 0))
    before = F.right(F.concat(F.element_at("s", F.col("nth") + 1)["r"], "name"), F.lit(NEAR))
    whole = F.substring(F.col("m"), F.char_length("name") + 1, F.char_length("m"))
    # marks behind a value without quotes belong to the sentence
    value = F.when(F.col("name").rlike("[\"']$|://"), whole).otherwise(F.regexp_replace(whole, r"[.!?:)\]}]+$", ""))
    return each.select("doc_id", "nth", value.alias("candidate"), before.alias("before"), F.element_at("s", F.col("nth") + 2)["l"].alias("after"), "path")


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """A labelled set for tables without one: (candidate, before, after, path, label), made by rule from hashes.

    Secrets: hex and base-62 tokens after key words, some in capitals, passwords of words, digits and marks, tokens of letters alone,
    dotted tokens with and without a key word. False positives: numbers, digests that are named so, identifiers,
    placeholders, repeated characters, tokens in test files, and words of prose behind a key word.
    """
    i = F.col("id").cast("string")
    hexes, more = F.sha2(F.concat(F.lit("a"), i), 256), F.sha2(F.concat(F.lit("b"), i), 512)
    b62 = F.regexp_replace(F.base64(F.unhex(more)), r"[+/=\n]", "")
    kind = F.pmod(F.xxhash64("id"), F.lit(18))

    def pick(values: list[str], salt: int) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(values))) + 1).cast("int"))

    key = pick(['token = "', "api_key: ", "SECRET='", 'password="', "Bearer ", 'TOKEN = "', "access-key="], 1)
    named = pick(["commit ", "sha256: ", "checksum=", "uuid ", "order ", "revision ", "example_token = \"", "invoice "], 2)
    plain = pick(["and the ", "of ", "", "see ", ", "], 3)
    word = F.concat(pick(WORDS, 4), F.lit("_"), pick(WORDS, 5), F.lit("_"), pick(WORDS, 6), F.pmod("id", F.lit(97)).cast("string"))
    word = F.when(F.col("id") % 2 == 0, word).otherwise(F.concat_ws("_", pick(["your", "my", "some", "old", "the"], 10), pick(["password", "credential", "passphrase", "bearer", "apikey"], 11), word, F.pmod("id", F.lit(7)).cast("string")))
    size = (F.lit(24) + F.pmod(F.xxhash64("id", F.lit(7)), F.lit(25))).cast("int")
    number = F.substring(F.regexp_replace(F.concat(hexes, more), "[a-f]", ""), F.lit(1), (F.lit(16) + F.pmod("id", F.lit(4))).cast("int"))
    token = F.when(F.col("id") % 3 == 0, F.substring(b62, F.lit(1), size)).when(F.col("id") % 3 == 1, F.left(hexes, F.lit(40))).otherwise(F.upper(F.left(more, F.lit(40))))
    letters = F.left(F.regexp_replace(F.concat(b62, F.base64(F.unhex(hexes))), "[^A-Za-z]", ""), size)
    mark = pick(["!", "#", "$", "_", "-", ""], 9)
    password = F.when(F.col("id") % 2 == 0, F.concat(F.initcap(pick(WORDS, 4)), F.left(b62, F.lit(4)), mark)).otherwise(F.concat(pick(WORDS, 4), F.pmod("id", F.lit(97)).cast("string"), mark, pick(WORDS, 5)))
    # Prefixes of tokens that are known by them.
    known = F.when(F.col("id") % 3 == 0, F.concat(F.lit("AKIA"), F.left(F.upper(b62), F.lit(16)))).otherwise(F.concat(pick(["ghp_", "sk-", "xoxb-"], 12), F.left(b62, F.lit(36))))
    dotted = F.concat(F.lit("eyJ"), F.substring(b62, 1, 17), F.lit("."), F.substring(b62, 20, 24), F.lit("."), F.substring(b62, 45, 22))
    uuid = F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12))
    prose = F.when(F.col("id") % 2 == 0, pick([w for w in WORDS if len(w) > 5], 4)).otherwise(F.concat(F.initcap(pick(WORDS, 4)), F.initcap(pick(WORDS, 5)), F.initcap(pick(WORDS, 6))))
    is_secret = (kind < 5) | kind.isin(12, 13, 14)
    rows = spark.range(n).select(
        F.when(kind == 5, number).when(kind == 6, F.left(hexes, F.lit(40))).when(kind == 7, word).when(kind == 8, F.concat(F.lit("your_"), word)).when(kind == 9, F.concat(F.repeat(F.lit("x"), 12), F.lit("0000"), F.repeat(F.lit("x"), 8))).when(kind == 10, uuid).when(kind.isin(12, 16), password).when(kind == 13, letters).when(kind == 14, F.when(F.col("id") % 4 < 2, dotted).otherwise(known)).when(kind == 15, prose).otherwise(token).alias("candidate"),
        F.when(kind.isin(6, 10), named).when(kind.isin(5, 7) | (kind.isin(8, 14) & (F.col("id") % 2 == 0)), plain).otherwise(key).alias("before"),
        F.when(is_secret | kind.isin(9, 11, 16, 17), F.lit('" ')).otherwise(F.lit(" ")).alias("after"),
        F.when(kind.isin(11, 16, 17), pick(["tests/fixtures/sample.py", "test_login.py", "docs/example.md", "vendor/mock.js"], 14)).otherwise(pick(["src0", "src7", "lib/main.py", "app/config.yaml", ""], 8)).alias("path"),
        is_secret.cast("double").alias("label"),
    )
    return rows


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, most: int = FINDINGS) -> RandomForestClassificationModel:
    """A forest from labelled findings: at most `most` of them, those of the smallest hashes."""
    some = features(findings.orderBy(F.xxhash64("candidate", "before")).limit(most))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(some).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=1, featuresCol="features", labelCol="label").fit(vectors)


def scan(docs: DataFrame, model: RandomForestClassificationModel, path: str | None = None) -> DataFrame:
    """(doc_id, nth, candidate, before, score, secret): all candidates with the forest's verdict, none dropped."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(candidates(docs, path)))
    scored = model.transform(rows).withColumn("score", F.round(vector_to_array("probability")[1], 6))
    return scored.select("doc_id", "nth", "candidate", "before", "score", (F.col("score") >= THRESHOLD).alias("secret"))


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    """Candidates of all documents and whether they are secrets."""
    from lorewell.session import table

    return scan(table(spark, sf_dir, "documents"), train(labelled_findings(spark)), "source")
