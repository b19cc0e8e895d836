"""Secret scan: candidates by pattern, false positives removed by a random forest.

Candidates are runs of token characters with a digit or the start of a known key, quoted or plain values after an assignment to a secret's name,
passwords in URLs and private key blocks. The forest looks at length, character classes and transitions, dictionary coverage, the path and the
neighbouring words. It is trained from labelled findings with Spark's RandomForestClassifier and then compiled into SQL
expressions, so that scoring, like everything else here, consists of built-in DataFrame functions. A text is cut at its
candidates once; features, scores and the redacted text are computed inside its row, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from math import log2

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.llm._shared import unused

# What candidates look like.
# A key block's body is taken in one way only, up to the next mark that opens a block or ends a key, so an open block is read once.
KEY_NAME = r"[A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
PRIVATE_KEY = rf"-----BEGIN {KEY_NAME}(?:[^-]++|-(?!----(?:BEGIN |END {KEY_NAME})))*+-----END {KEY_NAME}"
# The starts of keys that services hand out; with one, a token needs no digit. Those of capitals have a length of their own, as words may start so.
ID_STARTS, KEY_STARTS = r"AKIA|ASIA", r"ghp_|gho_|ghs_|xox[abpr]-|sk_live_|rk_live_|AIza|eyJ|glpat-"
PREFIXED = rf"(?<![A-Za-z0-9+/_-])(?:(?:{ID_STARTS})[A-Z0-9]{{16}}(?![A-Za-z0-9+/_=-])|(?:{KEY_STARTS})[A-Za-z0-9+/_-]{{12,}}+={{0,2}}+)"
TOKEN_RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}+"
# A match of IN_URL or ASSIGNED is a head (a user of a URL; a secret's name with quote, white space and separator) and the candidate.
USER = r"[^\s/:@\"']*+:"
IN_URL = rf"(?<=://){USER}[^\s/\"'<>]+(?=@)"
NAMES = r"(?i:passw(?:or)?d|passphrase|pwd|secret|token|(?:api|access|secret|private)[_-]?key)"
NAMED = rf"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]*+(?=[\"']?\s*+[=:])(?<={NAMES})[\"']?\s*+(?::=|=>|={{1,3}}+|:)\s*+[\"']?"
VALUE = r"[^\s\"'=:][^\s\"']{7,}+"
ASSIGNED = f"{NAMED}{VALUE}"
CANDIDATE = f"{PRIVATE_KEY}|{IN_URL}|{ASSIGNED}|{PREFIXED}|{TOKEN_RUN}"

# Words that stand next to secrets, next to other identifiers, in paths and in placeholders; common words, from whose
# letters the transition table is learned.
SECRET_WORDS = r"(?i)(key|token|secret|passw|pwd|auth|bearer|credential|private|signature|login)"
OTHER_WORDS = r"(?i)(commit|sha|hash|digest|checksum|uuid|guid|etag|revision|md5|build|version|card|isbn|phone|order|ticket|serial|integrity|object)"
QUIET_PATHS = r"(?i)(test|spec|fixture|mock|example|sample|doc|readme|lock|vendor|node_modules|changelog)"
PLACEHOLDERS = r"(?i)(example|sample|your|change_?me|dummy|placeholder|xxxx|test|fake|todo|12345678|00000000|(?-i:abcdef|ABCDEF)|^(pass(word|wd)?|secret|user(name)?)$)"
REFERENCES = r"^[$<{%\[]|\w[(\[]|^[a-z]+\.[A-Za-z_]+|^[*.#•]+$"
PREFIXES = rf"^({ID_STARTS}|{KEY_STARTS}|-----BEGIN)"
DICTIONARY = ("about after all and back base before between build case check class client close code common config content control copy count create current custom data date default delete device document each edit element enable end error event every example false field file filter find first format found from function general get global group handle header help host http image import index info input instance interface item java key label last layer left length level library like line link list load local long main make manager map master match message method model module month name need network new next node not note number object open option order other output over package page parent part path place plugin post present process project property public query read record release remote remove request reset resource response result return right root route row rule sample save schema screen script search section select server service session set show simple site size source space stage start state static status step string style system table tag target task template test text that the time title tool total track true type under update upload user value version view was window with word work write year zone").split()
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def transitions(words: list[str]) -> str:
    """How much likelier than by chance each letter comes after each other one in ``words``: log2, smoothed, 26 rows of 26 in
    steps of 1/10, as characters from STEP on."""
    seen = Counter(w[i : i + 2] for w in words for i in range(len(w) - 1))
    first = Counter(p[0] for p in seen.elements())
    return "".join(chr(STEP + round(10 * log2(26 * (seen[a + b] + 0.2) / (first[a] + 5.2)))) for a in LETTERS for b in LETTERS)


#: The character that stands for 0; all of the table is ASCII.
STEP = 80
TRANSITIONS = transitions(DICTIONARY)

#: Characters of context on either side; trees and depth of the forest; the score from which a candidate is a secret.
BEFORE, AFTER, TREES, DEPTH, THRESHOLD = 48, 16, 15, 6, 0.5
FEATURES = ("length", "digits", "upper", "lower", "symbols", "changes", "distinct", "is_hex", "transitions", "dictionary", "near_secret", "assigned", "near_other", "quiet_path", "prefix", "placeholder", "in_url", "reference")


def features(candidate: Column, before: Column, after: Column, path: Column) -> list[Column]:
    """The features of one candidate, in the order of FEATURES, as doubles."""
    n = F.greatest(F.length(candidate), F.lit(1)).cast("double")
    share = lambda pattern: (n - F.length(F.regexp_replace(candidate, pattern, ""))) / n
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(candidate, "[0-9]+", "\u0001"), "[a-z]+", "\u0002"), "[A-Z]+", "\u0003"), "[^\u0001-\u0003]+", "\u0004")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    low = F.lower(candidate)
    covered = lambda words: (n - F.length(F.regexp_replace(low, "|".join(words), ""))) / n
    code = F.transform(F.split(F.regexp_replace(low, "[^a-z]+", " "), ""), lambda x: F.ascii(x) - 97)
    follows = F.transform(F.slice(code, 2, F.greatest(F.size(code) - 1, F.lit(0))), lambda y, i: F.when((code[i] >= 0) & (y >= 0), (F.ascii(F.substr(F.lit(TRANSITIONS), 26 * code[i] + y + 1, F.lit(1))) - STEP) / 10))
    pairs = F.filter(follows, lambda x: x.isNotNull())
    likely = F.when(F.size(pairs) == 0, F.lit(-2.0)).otherwise(F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / F.size(pairs))
    return [
        n, share("[0-9]"), share("[A-Z]"), share("[a-z]"), share("[^0-9A-Za-z]"), (F.length(kinds) - 1) / n,
        F.size(F.array_distinct(F.split(candidate, ""))) / n, flag(candidate.rlike("^[0-9a-f]+$|^[0-9A-F]+$")), likely, covered(sorted(DICTIONARY, key=len, reverse=True)),
        flag(F.right(before, F.lit(28)).rlike(SECRET_WORDS)), flag(before.rlike("[=:]\\s?[\"']?$")), flag(F.concat(F.right(before, F.lit(28)), F.lit(" "), after).rlike(OTHER_WORDS)),
        flag(path.rlike(QUIET_PATHS)), flag(candidate.rlike(PREFIXES)), flag(candidate.rlike(PLACEHOLDERS)),
        flag(before.rlike("://[^\\s/:@]*:$")), flag(candidate.rlike(REFERENCES)),
    ]


def default_findings(spark: SparkSession, rows: int = 4_000) -> DataFrame:
    """Labelled findings (candidate, before, after, path, label) made by rule: 20 kinds of secrets, 20 of look-alikes.

    Characters come from digests of the row number, so the table is the same everywhere. ``rows`` bounds it.
    """
    base = spark.range(0, rows, 1, 1).selectExpr("id", "id % 40 AS kind", "sha2(concat('finding', id), 512) AS hex", "pmod(xxhash64(id, 3), 1000) AS r", "pmod(xxhash64(id, 4), 1000) AS q")
    base = base.selectExpr("*", "regexp_replace(base64(unhex(concat(hex, hex))), '[^A-Za-z0-9]', '') AS alnum", "regexp_replace(base64(unhex(hex)), '[\\\\s=]', '') AS b64")
    base = base.selectExpr("*", "element_at(split('the and that for with line value said here then over under main item', ' '), int(r % 14) + 1) AS word", "element_at(split('src/main.py app/config.yml lib/server.js deploy/prod.env src7 docs notes.txt data/page.html', ' '), int(q % 8) + 1) AS place")
    base = base.selectExpr("*", "element_at(split('hunter dragon monkey sunshine shadow coffee winter summer orange purple river battery horse correct staple wizard', ' '), int(q % 16) + 1) AS noun", "element_at(split('horse tiger falcon battery secret garden yellow silver rocket pepper', ' '), int(r % 10) + 1) AS other", "element_at(split('required undefined optional disabled encrypted username incorrect validation protected generated mandatory different', ' '), int(q % 12) + 1) AS prose")
    base = base.selectExpr("*", "concat(word, ' ', element_at(split('password PASSWORD Password DB_PASSWORD passwd pwd secret api_key API_KEY token', ' '), int(q % 10) + 1)) AS name", "element_at(array('=', ': ', ' = ', '\": \"', '\\': \\'', '=\"'), int(r % 6) + 1) AS sep")
    base = base.selectExpr("*", "concat(name, sep) AS assigned", "concat(word, ' ', element_at(split('postgres mysql https redis amqp', ' '), int(r % 5) + 1), '://', element_at(split('admin root app user', ' '), int(q % 4) + 1), ':') AS url")
    kinds = [
        # candidate, before, path, label
        ("substr(hex, 1, 40)", "concat(word, ' token = \"')", "place", 1),
        ("substr(hex, 1, 12 + r % 13)", "concat(word, ' password=')", "place", 1),
        ("concat('AKIA', substr(upper(alnum), 1, 16))", "concat(word, ' ')", "place", 1),
        ("concat('ghp_', substr(alnum, 1, 36))", "concat(word, ' ')", "place", 1),
        ("substr(b64, 1, 40)", "concat(word, ' secret_access_key = ')", "place", 1),
        ("concat('sk_live_', substr(alnum, 1, 24))", "concat(word, ' ')", "place", 1),
        ("concat('eyJ', substr(alnum, 1, 60))", "'authorization: bearer '", "place", 1),
        ("substr(alnum, 1, 32)", "concat(word, ' api_key: \"')", "place", 1),
        ("substr(alnum, 1, 10 + r % 14)", "concat(word, ' secret = \\'')", "place", 1),
        ("concat('-----BEGIN RSA PRIVATE KEY-----\\n', b64, '\\n-----END RSA PRIVATE KEY-----')", "concat(word, ' ')", "place", 1),
        ("concat('AKIA', substr(upper(alnum), 7, 16))", "concat('key ', word, ' id ')", "'src0'", 1),
        ("substr(hex, 1, 40)", "concat('commit ', word, ' ')", "place", 0),
        ("substr(hex, 1, 64)", "concat('sha256 ', word, ':')", "place", 0),
        ("concat(substr(hex, 1, 8), '-', substr(hex, 9, 4), '-', substr(hex, 13, 4), '-', substr(hex, 17, 4), '-', substr(hex, 21, 12))", "concat(word, ' uuid ')", "place", 0),
        ("substr(conv(substr(hex, 1, 15), 16, 10), 1, 16)", "concat(word, ' ', word, ' ')", "place", 0),
        ("concat('get', initcap(word), 'RequestHandlerVersion', r % 100)", "concat(word, ' ')", "place", 0),
        ("concat(word, '_default_config_value_', r)", "concat(word, ' = ')", "place", 0),
        ("concat('static/images/', word, '/page', r)", "concat(word, ' ')", "place", 0),
        ("concat('your_', word, '_token_12345678')", "'token = \"'", "place", 0),
        ("substr(hex, 1, 32)", "concat('md5 ', word, ' ')", "place", 0),
        ("concat('2024-0', 1 + r % 9, '-1', q % 9, 'T10-00-', 10 + r % 50)", "concat(word, ' ')", "place", 0),
        ("concat('test_token_', substr(hex, 1, 12))", "'token = \"'", "'tests/fixtures/sample.py'", 0),
        ("concat('AKIA', substr(upper(alnum), 1, 9), 'EXAMPLE')", "concat(word, ' key ')", "'docs/readme.md'", 0),
        ("substr(hex, 1, 40)", "concat('revision ', word, ' ')", "'package.lock'", 0),
        ("concat(word, r, word, '-', q, word, word)", "concat(word, ' ', word, ' ')", "place", 0),
        ("concat(noun, r % 100, other)", "assigned", "place", 1),
        ("concat(noun, other, element_at(split('battery staple castle window', ' '), int(q % 4) + 1))", "assigned", "place", 1),
        ("concat(initcap(translate(noun, 'aeo', '430')), '&', r % 100, 'x!')", "assigned", "place", 1),
        ("substr(regexp_replace(concat(alnum, alnum), '[0-9]', ''), 1, 12 + r % 20)", "assigned", "place", 1),
        ("concat(initcap(noun), initcap(other), '!', r % 100)", "assigned", "place", 1),
        ("concat(initcap(translate(noun, 'aeo', '430')), initcap(translate(other, 'aeo', '430')))", "url", "place", 1),
        ("substr(alnum, 1, 8 + r % 20)", "url", "place", 1),
        ("concat(noun, r % 1000, other)", "url", "place", 1),
        ("concat('-----BEGIN PGP PRIVATE KEY BLOCK-----\\n', b64, '\\n-----END PGP PRIVATE KEY BLOCK-----')", "concat(word, ' ')", "place", 1),
        ("prose", "assigned", "place", 0),
        ("element_at(array('os.environ[', concat('process.env.', upper(noun)), concat('config.', noun, '.', other), concat('self.', noun, '_', other)), int(q % 4) + 1)", "assigned", "place", 0),
        ("element_at(array(concat('get', initcap(noun), '(', word, ')'), concat('${', upper(noun), '_', upper(other), '}'), concat('<', word, '-', noun, '>'), repeat('*', 8 + int(r % 9)), concat('{{', noun, '_', other, '}}')), int(q % 5) + 1)", "assigned", "place", 0),
        ("element_at(array('password', 'passwd', 'pass', 'secret', '${PASSWORD}', '<password>'), int(r % 6) + 1)", "url", "place", 0),
        ("concat('your', substr('-_', int(r % 2) + 1, 1), noun, '-here')", "assigned", "place", 0),
        ("concat(prose, element_at(array('.', ',', ';', ')'), int(r % 4) + 1))", "concat(name, ': ')", "place", 0),
    ]
    choose = lambda i: "CASE kind " + " ".join(f"WHEN {k} THEN {x[i]}" for k, x in enumerate(kinds)) + " END"
    return base.selectExpr(f"{choose(0)} AS candidate", f"{choose(1)} AS before", "concat('\" ', word) AS after", f"{choose(2)} AS path", f"{choose(3)} AS label")


def compile_tree(text: str) -> list:
    """A tree of Spark's debug text as nested [feature, threshold, left, right] and leaves."""
    lines = [x for x in text.split("\n") if re.match(r"\s*(If|Else|Predict)", x)]

    def node(at: int) -> tuple:
        if m := re.match(r"\s*Predict: (\S+)", lines[at]):
            return float(m[1]), at + 1
        m = re.match(r"\s*If \(feature (\d+) <= (\S+)\)", lines[at])
        left, at = node(at + 1)
        right, at = node(at + 1)
        return [int(m[1]), float(m[2]), left, right], at

    return node(0)[0]


class Forest:
    """Trees as data; ``score`` turns them into a column expression over a struct of FEATURES."""

    def __init__(self, trees: list):
        self.trees = trees

    def score(self, f: Column) -> Column:
        def expression(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, most, left, right = node
            return F.when(f[FEATURES[feature]] <= F.lit(most), expression(left)).otherwise(expression(right))

        return reduce(lambda a, b: a + b, map(expression, self.trees)) / len(self.trees)


_forests: dict[str, Forest] = {}


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """A forest from labelled findings (candidate, before, after, path, label 0 or 1); null strings count as empty."""
    text = [F.coalesce(F.col(c), F.lit("")) for c in ("candidate", "before", "after", "path")]
    rows = findings.where("label IS NOT NULL").select(*[c.alias(n) for c, n in zip(features(*text), FEATURES, strict=True)], F.col("label").cast("double").alias("label"))
    # Kept while the forest grows, which reads its rows many times; a lost part is made again.
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", "label").persist()
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=17, featureSubsetStrategy="sqrt").fit(rows)
    rows.unpersist()
    return Forest([compile_tree(t.toDebugString) for t in model.trees])


def default_forest(spark: SparkSession) -> Forest:
    app = spark.sparkContext.applicationId
    if app not in _forests:
        _forests[app] = train(default_findings(spark))
    return _forests[app]


def scan(documents: DataFrame, forest: Forest, threshold: float = THRESHOLD, into: str = "secrets") -> DataFrame:
    """``documents`` with a column ``into``: struct(n_candidates, n_secrets, max_score, found array<string>, redacted).

    ``redacted`` is the text with every secret replaced by ``[SECRET]``; without secrets it is the text itself. A null
    text has no candidates and stays null, an empty one stays empty; texts of any length, with any number of candidates,
    are scanned whole, inside their row. A null source is an empty path. All other columns are kept, whatever their names
    (one named as ``into`` is replaced); rows are independent, so repeated rows have equal results. Empty input: no rows.
    """
    text, path = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in documents.columns else F.lit("")
    got, cut, scores = (unused(documents, c) for c in ("__got", "__cut", "__scores"))
    # Only a match in a URL ends before an @: other values take it in, and other candidates hold no colon.
    head = lambda x, i: F.when(F.startswith(F.col(cut)[i + 1], F.lit("@")), F.regexp_extract(x, f"^{USER}", 0)).otherwise(F.regexp_extract(x, f"^{NAMED}(?={VALUE}\\z)", 0))
    parts = lambda x, i: F.struct(head(x, i).alias("head"), F.substr(x, F.length(head(x, i)) + 1).alias("c"))
    # White space in a head counts as one blank, so that the name stays in view.
    before = lambda x, i: F.right(F.concat(F.col(cut)[i], F.regexp_replace(x["head"], r"\s+", " ")), F.lit(BEFORE))
    told = lambda x, i: F.struct(*[f.alias(n) for f, n in zip(features(x["c"], before(x, i), F.left(F.col(cut)[i + 1], F.lit(AFTER)), path), FEATURES, strict=True)])
    rows = documents.withColumn(got, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).withColumn(cut, F.when(F.size(got) > 0, F.split(text, CANDIDATE, -1)))
    rows = rows.withColumn(got, F.transform(got, parts))
    rows = rows.withColumn(scores, F.transform(F.transform(got, told), forest.score))
    hits = F.filter(F.arrays_zip(F.col(f"{got}.c").alias("c"), F.col(scores).alias("s")), lambda x: x["s"] >= threshold)
    after = F.transform(got, lambda x, i: F.concat(x["head"], F.when(F.col(scores)[i] >= threshold, F.lit("[SECRET]")).otherwise(x["c"]), F.col(cut)[i + 1]))
    redacted = F.when(F.col("text").isNull(), F.lit(None).cast("string")).when(F.size(got) == 0, text).otherwise(F.concat(F.col(cut)[0], F.array_join(after, "")))
    out = F.struct(F.size(got).cast("long").alias("n_candidates"), F.size(hits).cast("long").alias("n_secrets"), F.coalesce(F.array_max(scores), F.lit(0.0)).alias("max_score"), F.transform(hits, lambda x: x["c"]).alias("found"), redacted.alias("redacted"))
    return rows.withColumn(into, out).drop(got, cut, scores)
