"""Secret scans: candidate strings in texts, and a random forest that removes the false positives.

Candidates are of three forms: the value after an assignment whose name asks for a secret, of four or more characters
and any alphabet up to white space, a quote, ``&``, ``,`` or ``;``; a dotted triple as in signed tokens, whole; and maximal
runs of 16 or more token characters that hold a digit or follow an assignment, of which a run that begins with names and
``=`` (as in env files and URLs) is its value of 6 or more characters alone. The forest
sees a candidate's length, its character transitions (class changes, and how likely its letter pairs are in words of
the corpus), its dictionary coverage, its path and its neighbouring words. It is trained from labelled findings.

Everything is DataFrame functions and the DataFrame form of Spark's random forest. The dictionary and the letter
pairs count every text; the forest is fitted on at most about ``TRAIN_ROWS`` labelled rows, chosen by a hash of
their key and trained in one order, so the model does not depend on the layout.

Labelled findings are a table (key, candidate, before, after, path, secret). Where none is at hand,
``planted_findings`` derives one from documents: secrets and harmless strings of known kind are put between words of
the documents.

Defined cases: null or empty texts have no candidates; rows with the same doc_id and text share their findings (a null
doc_id is a value like others); without labelled findings of both kinds no forest can be fitted, and every candidate
counts as a secret, with a null score; the time per candidate grows with its length alone; text next to a candidate is looked at for ``AROUND`` characters, the candidate in full.
Columns other than doc_id, text and the path are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.llm.storage import shared_folder, stored

_TOKEN = r"[A-Za-z0-9+/=_\-]"
_NAME = r"[A-Za-z0-9_\-]"
#: Words of names that ask for a secret.
_ASK = r"(?i:token|secret|passw|pwd|passphrase|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key|client[_-]?key)"
#: Such a name, its assignment, and what may stand before the value.
_ASKED = rf"(?<!{_NAME}){_NAME}{{0,60}}?{_ASK}{_NAME}{{0,20}}[\"'`]?\s{{0,3}}[:=]{{1,2}}>?\s{{0,3}}(?:(?:Bearer|Basic)\s{{1,3}})?[\"'`]?"
_REST = r"[^\s\"'`&,;]"
RUN = rf"{_ASKED}{_REST}{{4,}}|{_NAME}{{10,}}\.{_NAME}{{10,}}\.{_NAME}{{10,}}|{_TOKEN}{{16,}}"
VALUE = rf"{_REST}{{4,}}"
#: What stands before the value in a run: an asking name with its assignment, or names with = where a value follows.
NAMED = rf"^(?:{_ASKED}(?={_REST}{{4}})|(?:[A-Za-z_\-]{_NAME}*=+){{1,8}}(?=[^=]{_TOKEN}{{5}}))"
AROUND = 64
#: Runs that the text around a candidate can hold: each has 8 characters and one more beside it.
RUNS_AROUND = 7
MASK = "[SECRET]"
TRAIN_ROWS = 20_000
STRETCH = 64
DICTIONARY_MIN = 5
TREES, DEPTH, SEED = 40, 8, 7
THRESHOLD = 0.5

ASSIGNED = r"[:=]>?\s{0,3}[\"'`]?$"
ASKING = r"(?i)(token|secret|passw|pwd|passphrase|api[ _-]?key|access[ _-]?key|auth|bearer|credential|private[ _-]?key|client[ _-]?key)"
HARMLESS = r"(?i)(example|sample|dummy|placeholder|commit|checksum|digest|sha-?\d*|md5|uuid|guid|hash|revision|phone|card|order|serial|tracking|isbn)"
TEST_PATH = r"(?i)(^|[^a-z])(tests?|examples?|docs?|fixtures?|samples?|mocks?)([^a-z]|$)"
CONFIG_PATH = r"(?i)(\.(env|ya?ml|json|ini|cfg|conf|toml|properties|pem|key)$|config|settings|deploy)"

FEATURES = [
    "length", "digits", "uppers", "others", "changes", "distinct", "hex", "pair_score", "coverage", "assigned", "quoted",
    "asked", "asked_near", "harmless", "word_before", "word_after", "test_path", "config_path",
]
_FINDING = ["doc_id", "_text_hash", "place", "candidate", "before", "after", "path", "position"]
_LETTERS = 28


def find_candidates(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, _text_hash, place, candidate, before, after, path, position) of each candidate.

    ``place`` counts all runs of a text from 0, ``position`` is the candidate's first character, from 0. ``before`` and
    ``after`` are the text around the candidate, other runs included.
    """
    where = F.lit("") if path is None else F.coalesce(F.col(path).cast("string"), F.lit(""))
    texts = docs.select("doc_id", "text", where.alias("path")).where(F.col("text").rlike(RUN))
    cut = texts.select(
        "doc_id", "path", F.xxhash64("text").alias("_text_hash"),
        F.split("text", RUN, -1).alias("pieces"), F.regexp_extract_all("text", F.lit(RUN), F.lit(0)).alias("runs"),
    )
    tail = lambda array, i: F.when(i >= 0, F.right(F.get(array, i), F.lit(AROUND))).otherwise("")
    head = lambda array, i: F.coalesce(F.left(F.get(array, i), F.lit(AROUND)), F.lit(""))
    back, on = range(RUNS_AROUND, 0, -1), range(1, RUNS_AROUND + 1)
    before = lambda i: [x for k in back for x in (tail("pieces", i - k), tail("runs", i - k))] + [tail("pieces", i)]
    after = lambda i: [head("pieces", i + 1)] + [x for k in on for x in (head("runs", i + k), head("pieces", i + k + 1))]
    parts = F.transform(
        "runs",
        lambda x, i: F.struct(
            i.cast("long").alias("place"),
            F.regexp_replace(x, NAMED, "").alias("candidate"),
            F.right(F.concat(*before(i), F.regexp_extract(x, NAMED, 0)), F.lit(AROUND)).alias("before"),
            F.left(F.concat(*after(i)), F.lit(AROUND)).alias("after"),
            (F.length(F.get("pieces", i)) + F.length(x)).cast("long").alias("gap"),
        ),
    )
    runs = cut.select("doc_id", "path", "_text_hash", F.explode(parts).alias("r")).select("doc_id", "path", "_text_hash", "r.*")
    one = runs.groupBy("doc_id", "_text_hash", "place").agg(*[F.first(c).alias(c) for c in ("candidate", "before", "after", "path", "gap")])
    earlier = Window.partitionBy("doc_id", "_text_hash").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = one.withColumn("position", F.sum("gap").over(earlier) - F.length("candidate"))
    wanted = F.col("candidate").rlike("[0-9]") | F.col("before").rlike(ASSIGNED)
    return placed.where(wanted).select(*_FINDING)


def corpus_dictionary(docs: DataFrame, least: int = DICTIONARY_MIN) -> DataFrame:
    """(word, n): words of 4 to 8 letters a-z that the texts hold ``least`` times or more."""
    words = docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    counted = words.where(F.length("word").between(4, 8)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least)


def _codes(text: Column) -> Column:
    """Per character 1-26 for a letter, 27 for a digit, 0 for others, in one pass over the text."""

    def code(letter: Column) -> Column:
        at = F.ascii(letter)
        return F.when(at.between(97, 122), at - 96).when(at.between(48, 57), F.lit(27)).otherwise(F.lit(0))

    return F.transform(F.split(text, ""), code)


def _pairs(text: Column) -> Column:
    """The pairs of neighbouring characters, each first * 28 + second."""
    codes, n = _codes(text), F.length(text)
    few = F.greatest(n - 1, F.lit(0))
    return F.zip_with(F.slice(codes, F.lit(1), few), F.slice(codes, F.lit(2), few), lambda a, b: a * _LETTERS + b)


def pair_scores(dictionary: DataFrame) -> DataFrame:
    """One row: an array with the log probability of each pair of letters in the dictionary's words, by
    first * 28 + second; never-seen pairs count as half a time."""
    pairs = dictionary.select(F.explode(_pairs(F.col("word"))).alias("pair"), "n")
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    every = dictionary.sparkSession.range(_LETTERS * _LETTERS).select(F.col("id").cast("int").alias("pair"))
    full = every.join(counts, "pair", "left").select("pair", (F.coalesce("n", F.lit(0)) + 0.5).alias("n"))
    listed = full.agg(F.array_sort(F.collect_list(F.struct("pair", "n"))).alias("l"), F.sum("n").alias("total"))
    return listed.select(F.transform("l", lambda x: F.log10(x["n"] / F.col("total"))).alias("scores"))


def finding_features(findings: DataFrame, keys: list[str], dictionary: DataFrame, scores: DataFrame) -> DataFrame:
    """Keys and FEATURES of findings (candidate, before, after, path)."""
    low, n = F.lower("candidate"), F.length("candidate")
    share = lambda pattern: F.regexp_count("candidate", F.lit(pattern)) / n
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace("candidate", "[0-9]+", "0"), "[A-Z]+", "A"), "[a-z]+", "a")
    likely = F.aggregate(_pairs(low), F.lit(0.0), lambda s, pair: s + F.get("scores", pair))
    flag = lambda c: c.cast("double")
    given = findings.select(*keys, "candidate", "before", "after", "path").crossJoin(F.broadcast(scores))
    near = F.substring_index(F.regexp_replace("before", r"[^A-Za-z0-9]+", " "), " ", -4)
    out = given.select(
        *keys,
        _identity().alias("_id"),
        F.log(n).alias("length"),
        share("[0-9]").alias("digits"),
        share("[A-Z]").alias("uppers"),
        share("[^A-Za-z0-9]").alias("others"),
        (F.length(kinds) / n).alias("changes"),
        (F.size(F.array_distinct(F.split("candidate", ""))) / n).alias("distinct"),
        flag(F.col("candidate").rlike("^([0-9a-f]+|[0-9A-F]+)$")).alias("hex"),
        (likely / (n - 1)).alias("pair_score"),
        flag(F.col("before").rlike(ASSIGNED)).alias("assigned"),
        flag(F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")).alias("quoted"),
        flag(F.col("before").rlike(ASKING)).alias("asked"),
        flag(near.rlike(ASKING)).alias("asked_near"),
        flag(near.rlike(HARMLESS)).alias("harmless"),
        flag(F.col("before").rlike(r"[A-Za-z]\s+$")).alias("word_before"),
        flag(F.col("after").rlike(r"^\s+[A-Za-z]")).alias("word_after"),
        flag(F.col("path").rlike(TEST_PATH)).alias("test_path"),
        flag(F.col("path").rlike(CONFIG_PATH)).alias("config_path"),
    )
    covered = _coverage(given.select("candidate"), dictionary)
    return out.join(covered, "_id", "left").select(*keys, *[F.coalesce(F.col(f), F.lit(0.0)).alias(f) for f in FEATURES])


def _identity() -> Column:
    """What stands for a candidate of any length in joins and groups."""
    return F.md5("candidate")


def _coverage(candidates: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(_id, coverage): share of a candidate's characters inside dictionary words.

    Candidates are cut into stretches of ``STRETCH`` characters that overlap by a word less one letter; substrings of a
    stretch are looked up in a join, so rows stay short at any length. The characters that a word adds to those before
    it are summed in order of place.
    """
    each = candidates.groupBy(_identity().alias("_id")).agg(F.first(F.lower("candidate")).alias("low"))
    cut = F.regexp_extract_all("low", F.lit(rf"(?s).{{1,{STRETCH}}}"), F.lit(0))
    longer = F.zip_with(cut, F.slice(cut, F.lit(2), F.size(cut)), lambda x, y: F.concat(x, F.coalesce(F.left(y, F.lit(7)), F.lit(""))))
    cuts = each.select("_id", F.length("low").alias("length"), F.posexplode(longer).alias("stretch", "part"))
    size = F.length("part")
    at = cuts.where(size >= 4).select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(STRETCH), size - 3))).alias("at"))
    parts = at.select("*", F.explode(F.sequence(F.lit(4), F.least(F.lit(8), size - F.col("at") + 1))).alias("k"))
    i = F.col("stretch") * STRETCH + F.col("at")
    parts = parts.select("_id", "length", i.alias("i"), "k", F.substring("part", F.col("at"), F.col("k")).alias("word"))
    parts = parts.where(F.col("word").rlike("^[a-z]+$"))
    found = parts.join(dictionary.select("word"), "word").groupBy("_id", "length", "i").agg((F.max("i") + F.max("k")).alias("end"))
    before = Window.partitionBy("_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(before), F.lit(0))
    fresh = found.select("_id", "length", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("i"), reach)).alias("n"))
    return fresh.groupBy("_id").agg((F.sum("n") / F.first("length")).alias("coverage"))


def _fraction(hashed: Column) -> Column:
    """A hash as a number from 0 to below 1."""
    return F.pmod(hashed, F.lit(1 << 30)) / float(1 << 30)


def planted_findings(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Labelled findings (key, candidate, before, after, path, secret), about ``rows`` of them.

    Each document gives secrets in settings, env files, URLs and running text, and harmless strings in the same places;
    digests of its doc_id make the strings, words of its text, from places that a hash picks, stand around them, and
    paths are drawn alike for both.
    """
    seed = lambda k: F.concat_ws(":", F.lit(k), F.col("doc_id").cast("string"))
    word = lambda k: F.coalesce(F.get("words", F.pmod(F.xxhash64("doc_id", F.lit(k)), F.size("words"))), F.lit("the"))
    hexed = lambda k, n: F.left(F.sha2(seed(k), 256), F.lit(n))
    base = lambda k, n: F.left(F.base64(F.unhex(F.sha2(seed(k), 256))), F.lit(n))
    base_url = lambda k, n: F.translate(base(k, n), "+/=", "-_x")
    marked = lambda c: F.translate(c, "AbCdEfG3+/", "!@#$%^*?~!")
    digits = lambda k, n: F.left(F.concat(F.lit("4"), F.abs(F.xxhash64("doc_id", F.lit(k))).cast("string"), F.lit("0000000000000000")), F.lit(n))
    names = F.array(*[F.lit(x) for x in ("token", "api_key", "secret", "password", "access_key", "auth_token", "client_secret")])
    name = lambda k: F.get(names, F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(7)))
    long_names = F.array(*[F.lit(x) for x in ("production_db_password", "aws_secret_access_key", "stripe_live_secret_key", "github_personal_access_token", "internal_service_auth_token")])
    long_name = lambda k: F.get(long_names, F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(5)))
    letters = F.regexp_replace(F.concat(*[word(k) for k in range(20, 26)]), "[^A-Za-z]", "")
    lit = F.lit
    kinds = [
        (True, hexed("a", 40), (" ", name(1), ' = "'), '" '),
        (True, base("b", 40), (" ", name(2), ": "), "\n"),
        (True, F.concat(lit("sk_"), hexed("c", 32)), (" ", name(3), "='"), "' "),
        (True, F.upper(hexed("m", 40)), (" ", F.upper(name(5)), ' = "'), '" '),
        (False, hexed("d", 40), (" commit ",), " "),
        (False, hexed("e", 64), (" sha256: ",), "\n"),
        (False, hexed("f", 32), (" md5 checksum ",), ", "),
        (False, digits("g", 16), (" ",), " "),
        (False, digits("h", 18), (" order ",), ". "),
        (False, F.concat_ws("-", hexed("i", 8), hexed("j", 4), hexed("k", 12)), (" uuid ",), " "),
        (False, F.concat(letters, lit("42x")), (" ",), " "),
        (False, F.concat_ws("/", word(30), word(31), word(32), lit("v2")), (" ",), " "),
        (False, F.concat(lit("example_"), name(4), lit("_1234567890")), (" ", name(4), ' = "'), '" '),
        (False, F.concat(letters, lit("-2024")), (" title = ",), " "),
        (True, hexed("n", 64), (" ", long_name(6), ' = "'), '" '),
        (True, base("o", 40), ("\n", F.upper(long_name(7)), "="), "\n"),
        (True, hexed("p", 32), (" https://api.example.net/v1/items?page=2&", name(8), "="), "&sort=up "),
        (True, base("q", 12), ("\n", F.upper(long_name(9)), "="), "\n"),
        (True, base("r", 18), (" ", name(10), ": '"), "' "),
        (True, base("s", 40), (" the ", name(11), " is "), " "),
        (True, hexed("t", 40), ("\n", F.upper(name(12)), "="), "\n"),
        (False, hexed("u", 40), ("\nBUILD_COMMIT_REVISION=",), "\n"),
        (False, hexed("v", 64), (' package_sha256_checksum = "',), '" '),
        (False, digits("w", 16), (" https://shop.example.net/view?page=2&order=",), "&sort=up "),
        (False, hexed("x", 40), (" ", name(13), ' = "', hexed("y", 24), '" commit '), " "),
        (False, digits("z", 16), (" ", name(14), ' = "', hexed("A", 24), '" and card '), " "),
        (False, F.concat_ws("_", word(33), word(34), lit("report_v2")), ("\nDEFAULT_TITLE_NAME=",), "\n"),
        (False, hexed("B", 32), (" document_uuid: '",), "' "),
        (True, base("C", 12), (" ", name(15), ' = "'), '" '),
        (True, marked(base("D", 20)), (" ", name(16), ' = "'), '" '),
        (True, marked(base("E", 10)), (" ", name(17), ": "), "\n"),
        (True, F.concat_ws(".", F.concat(lit("eyJ"), hexed("F", 17)), F.concat(lit("eyJ"), base_url("G", 40)), base_url("H", 43)), (" Authorization: Bearer ",), "\n"),
        (True, F.concat_ws(".", F.concat(lit("eyJ"), hexed("I", 17)), F.concat(lit("eyJ"), base_url("J", 40)), base_url("K", 43)), (" ",), " "),
        (False, F.lower(word(35)), (" ", name(18), ": "), " "),
        (False, F.concat_ws("_", lit("your"), name(19), lit("here")), (" ", name(19), ' = "'), '" '),
        (False, F.concat(F.upper(word(36)), lit("_"), F.upper(word(37))), (" ", name(20), ' = "'), '" '),
        (False, F.concat(lit("os.environ."), F.lower(word(38))), (" ", name(21), " = "), "\n"),
        (False, F.concat_ws(".", F.concat(word(39), word(40), word(41)), F.concat(word(42), word(43), word(44)), F.concat(word(45), word(46), word(47))), (" ",), " "),
    ]
    picked = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    picked = picked.where(_fraction(F.xxhash64("doc_id", F.lit(SEED))) < rows / (len(kinds) * max(1, docs.count())))
    picked = picked.groupBy("doc_id").agg(F.max("text").alias("text"))
    paths = F.array(*[F.lit(x) for x in ("", "src/main.py", "app/config.yml", ".env", "tests/test_main.py", "docs/index.md", "src3")])
    path = F.get(paths, F.pmod(F.xxhash64("doc_id", F.lit("path"), "f.kind"), F.lit(7)))
    made = F.array(
        *[
            F.struct(
                lit(k).alias("kind"),
                F.regexp_extract(c, VALUE, 0).alias("candidate"),
                F.concat(word(2 * k + 50), lit(" "), word(2 * k + 51), *[x if isinstance(x, Column) else lit(x) for x in before]).alias("before"),
                F.concat(lit(after), word(k + 90)).alias("after"),
                lit(secret).alias("secret"),
            )
            for k, (secret, c, before, after) in enumerate(kinds)
        ]
    )
    planted = picked.withColumn("words", F.split("text", r"\s+")).select("doc_id", F.explode(made).alias("f"))
    return planted.where(F.col("f.candidate") != "").select(F.concat_ws(":", "doc_id", "f.kind").alias("key"), "f.*", path.alias("path")).drop("kind")


def train_forest(features: DataFrame, rows: int = TRAIN_ROWS) -> PipelineModel:
    """Random forest on (key, FEATURES, secret); of more than ``rows`` rows, about that many chosen by hash."""
    taken = features.where(_fraction(F.xxhash64("key")) < rows / max(1, features.count()))
    # One bounded partition in a fixed order: the trees' row samples do not depend on the layout.
    ordered = taken.withColumn("label", F.col("secret").cast("double")).coalesce(1).sortWithinPartitions("key")
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, predictionCol="_prediction",
        rawPredictionCol="_raw", probabilityCol="_probability",
    )
    return PipelineModel([assembler, forest.fit(assembler.transform(ordered))])


def scan(docs: DataFrame, path: str | None = None, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per candidate: the finding's columns, ``score`` (the share of the forest for a secret) and ``secret``."""
    folder = shared_folder(docs.sparkSession)
    dictionary = stored(corpus_dictionary(docs), folder)
    scores = stored(pair_scores(dictionary), folder)
    found = stored(find_candidates(docs, path), folder)
    keys = ["doc_id", "_text_hash", "place"]
    labelled = stored(planted_findings(docs) if labelled is None else labelled, folder)
    examples = stored(finding_features(labelled, ["key", "secret"], dictionary, scores), folder)
    if examples.groupBy("secret").count().count() < 2:
        judged = found.withColumn("score", F.lit(None).cast("double"))
        return judged.withColumn("secret", F.lit(True))
    model = train_forest(examples)
    features = finding_features(found, keys, dictionary, scores)
    judged = model.transform(features).select(*keys, vector_to_array("_probability")[1].alias("score"))
    same = reduce(lambda a, b: a & b, [F.col(f"f.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
    joined = found.alias("f").join(judged.alias("s"), same).select("f.*", "s.score")
    return joined.withColumn("secret", F.col("score") >= threshold)


def mask_secrets(docs: DataFrame, findings: DataFrame, mask: str = MASK) -> DataFrame:
    """Documents with each secret's characters replaced by ``mask``; all rows and columns stay."""
    marked = findings.where("secret").groupBy("doc_id", "_text_hash").agg(F.collect_set("place").alias("_places"))
    marked = marked.select(F.col("doc_id").alias("_doc"), F.col("_text_hash").alias("_hash"), "_places")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_hash"))
    joined = docs.join(marked, same, "left")
    runs = F.regexp_extract_all("text", F.lit(RUN), F.lit(0))
    hidden = F.transform(runs, lambda x, i: F.when(F.array_contains("_places", i.cast("long")), F.concat(F.regexp_extract(x, NAMED, 0), F.lit(mask))).otherwise(x))
    new = F.array_join(F.zip_with(F.split("text", RUN, -1), hidden, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return joined.withColumn("text", F.when(F.col("_places").isNull(), F.col("text")).otherwise(new)).select(*docs.columns)
