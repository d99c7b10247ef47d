"""Secret scans: regular expressions find candidates, a random forest removes false positives; SQL functions alone on the main path.

Features of a candidate: its length, transitions between character classes, shares of digits, upper-case letters and vowels, share of
distinct characters, how much of it dictionary words and runs of one character cover, whether it looks like a path or a plain number, and
whether the neighbouring words name a credential or an example. The dictionary is what the documents themselves say: the DICTIONARY words of
five to twelve letters that most documents hold, besides a few that placeholders are made of. The forest is trained on labelled findings with
numpy on the driver (the features of those come from the same SQL expressions) and applied as one SQL expression of nested conditions.

Labelled findings are a table, a file or rows of found, before, after, label: the matched text, up to CONTEXT characters on either side of it,
and 1 for a secret or 0 for none (`read_labelled` reads CSV with a header, JSON lines or Parquet). Of a larger table MOST_LABELLED rows, chosen
by hash, are learned from. The test tables hold none, so without any `labelled_findings` draws them from a seeded generator: real-looking
keys of each kind and their look-alikes (placeholders, words, paths, versions, identifiers).
"""

from __future__ import annotations

import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_column

# Public formats of credentials, most specific first, and the words around them.
FORMATS = {
    "aws_access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    "slack_token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "stripe_key": r"\b[sr]k_(?:live|test)_[A-Za-z0-9]{16,}\b",
    "google_key": r"\bAIza[0-9A-Za-z_-]{35}",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "openai_key": r"\bsk-(?:proj-|svcacct-|ant-)?[A-Za-z0-9_-]{32,}",
    "gitlab_token": r"\bgl(?:pat|ptt|dt|rt)-[A-Za-z0-9_-]{20,}",
    "npm_token": r"\bnpm_[A-Za-z0-9]{36}\b",
    "huggingface_token": r"\bhf_[A-Za-z0-9]{30,}\b",
    "sendgrid_key": r"\bSG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}",
    "private_key": r"-----BEGIN (?:[A-Z ]*PRIVATE KEY|PGP PRIVATE KEY BLOCK)-----(?:(?:[^-]++|-(?!----))*+-----END (?:[A-Z ]*PRIVATE KEY|PGP PRIVATE KEY BLOCK)-----)?+",
    "url_password": r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@\"'<>]{1,64}:[^\s/:@\"'<>]{3,}+@",
    "assignment": r"(?i:api[_-]?key|access[_-]?key|secret(?:[_-]?key)?|token|passw(?:or)?d|passwd|pwd|credentials?|bearer|auth[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?[^\s\"'<>,;(){}]{6,}+",
}
CANDIDATE = "|".join(FORMATS.values())
#: What comes before the value in a match.
_LEAD = r"(?i)^[a-z][a-z0-9+.-]{1,20}://[^\s/:@\"'<>]{1,64}:|^(?:api[_-]?key|access[_-]?key|secret(?:[_-]?key)?|token|passw(?:or)?d|passwd|pwd|credentials?|bearer|auth[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?"
_KEYWORD = r"(?i)^(?:api[_-]?key|access[_-]?key|secret(?:[_-]?key)?|token|passw(?:or)?d|passwd|pwd|credentials?|bearer|auth[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?"
WORDS = r"example|sample|placeholder|changeme|change|your|dummy|fake|test|password|passwd|secret|token|key|here|insert|redacted|none|null|true|false|value|string|config|user|admin|default|localhost|http|https|www|com|the|and|for|with|this|that|from|name|file|path|home|env|process|get|set|abc|qwerty|letmein|welcome"
EXAMPLES = r"(?i)example|sample|dummy|placeholder|fake|test|docs?\b|e\.g\."
CONTEXT = 40
#: Words of the corpus's dictionary; the documents that must hold one; labelled findings that are learned from at most.
DICTIONARY, LEAST_DOCUMENTS, MOST_LABELLED = 2000, 5, 20_000
THRESHOLD = 0.5
FEATURES = ("length", "transitions", "digits", "uppers", "vowels", "distinct", "dictionary", "repeats", "path", "number", "named", "example")


def _share(value: Column, pattern: str) -> Column:
    return (F.length(value) - F.length(F.regexp_replace(value, pattern, ""))) / F.greatest(F.length(value), F.lit(1))


def dictionary(documents: DataFrame, words: int = DICTIONARY, least: int = LEAST_DOCUMENTS) -> list[str]:
    """The words (five to twelve letters a to z, lower-cased) that most documents hold, counted over all of them; ties by word."""
    own = documents.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text_column(documents)), F.lit(r"\b[a-z]{5,12}\b"), F.lit(0)))).alias("w"))
    counts = own.groupBy("w").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least)
    return [r.w for r in counts.orderBy(F.col("c").desc(), "w").limit(words).collect()]


def feature_columns(value: Column, found: Column, before: Column, after: Column, words: list[str] = ()) -> dict[str, Column]:
    """The features by name; `words` are the corpus's dictionary."""
    known = "|".join([WORDS, *sorted(words, key=lambda w: (-len(w), w))])
    classes = F.translate(value, string.ascii_lowercase + string.ascii_uppercase + string.digits, "a" * 26 + "A" * 26 + "9" * 10)
    runs = F.length(F.regexp_replace(classes, r"(.)\1+", "$1"))
    return {
        "length": F.least(F.length(value), F.lit(512)).cast("double"),
        "transitions": runs / F.greatest(F.length(value), F.lit(1)),
        "digits": _share(value, "[0-9]"),
        "uppers": _share(value, "[A-Z]"),
        "vowels": _share(value, "(?i)[aeiou]"),
        "distinct": F.size(F.array_distinct(F.split(F.lower(value), ""))) / F.least(F.greatest(F.length(value), F.lit(1)), F.lit(36)),
        "dictionary": _share(value, f"(?i)(?:{known})"),
        "repeats": _share(value, r"(.)\1{2,}|0123|1234|2345|3456|4567|5678|6789|abcd|xyz"),
        "path": value.rlike(r"://|^[/~.]|\w/\w+/|\w\.\w+\.\w|\$\{|%[A-Z]|\[|^<").cast("double"),
        "number": value.rlike(r"^[0-9.,:/-]+$|^[0-9a-f]{8}-[0-9a-f]{4}-").cast("double"),
        "named": found.rlike(_KEYWORD).cast("double"),
        "example": F.concat(before, F.lit(" "), after).rlike(EXAMPLES).cast("double"),
    }


def value_of(found: Column) -> Column:
    """The secret in a match: without the name it is assigned to, or the scheme, user and @ of a URL."""
    return F.regexp_replace(F.regexp_replace(found, _LEAD, ""), r"(?<=.)@$", "")


def _draw(rng: random.Random, alphabet: str, low: int, high: int | None = None) -> str:
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high or low)))


def labelled_findings(n: int = 3000, seed: int = 13) -> list[tuple[str, str, str, int]]:
    """(found, before, after, label): the bounded, seeded training set."""
    rng = random.Random(seed)
    low, up, num = string.ascii_lowercase, string.ascii_uppercase, string.digits
    hexa, every = "0123456789abcdef", string.ascii_letters + string.digits
    words = [w for w in WORDS.split("|") if len(w) > 3]
    filler = ["of the", "and then", "ist das", "por que", "see below", "config", "le de la", "export", "in this"]
    keys = ["token", "password", "secret", "api_key", "apikey", "access_key", "passwd", "pwd", "secret_key", "credential"]
    join = ["=", " = ", ": ", '="', " = \"", ": '"]
    out = []

    def word():
        return "".join(rng.choice(["an", "ter", "tion", "ble", "con", "er", "re", "st", "ing", "ed", "or", "ch", "ver", "la", "que"]) for _ in range(rng.randint(2, 4)))

    def assigned(v):
        return rng.choice(keys) + rng.choice(join) + v

    true = [
        lambda: "AKIA" + _draw(rng, up + "234567", 16),
        lambda: "AKIA" + _draw(rng, up + num, 16),
        lambda: "ghp_" + _draw(rng, every, 36),
        lambda: "xoxb-" + _draw(rng, num, 11) + "-" + _draw(rng, every, 24),
        lambda: "sk_live_" + _draw(rng, every, 24),
        lambda: "AIza" + _draw(rng, every + "_-", 35),
        lambda: "sk-" + rng.choice(["", "proj-"]) + _draw(rng, every + "_-", 40, 120),
        lambda: "glpat-" + _draw(rng, every + "_-", 20),
        lambda: rng.choice(["npm_", "hf_"]) + _draw(rng, every, 36),
        lambda: "SG." + _draw(rng, every + "_-", 22) + "." + _draw(rng, every + "_-", 43),
        lambda: rng.choice(["postgres", "mysql", "https", "amqp"]) + "://" + word() + ":" + _draw(rng, every + "!#%&*", 8, 24) + "@",
        lambda: "eyJ" + _draw(rng, every, 20, 40) + ".eyJ" + _draw(rng, every, 30, 90) + "." + _draw(rng, every + "_-", 43),
        lambda: "-----BEGIN " + (kind := rng.choice(["RSA ", "EC ", "", "OPENSSH "])) + "PRIVATE KEY-----" + rng.choice(["", "\n" + _draw(rng, every + "+/", 64, 1600) + "\n-----END " + kind + "PRIVATE KEY-----"]),
        lambda: assigned(_draw(rng, hexa, 16, 64)),
        lambda: assigned(_draw(rng, every, 16, 48)),
        lambda: assigned(_draw(rng, every + "+/", 20, 60) + "=="),
        lambda: assigned(_draw(rng, every + "!#%&*", 9, 20)),
        lambda: assigned(word() + _draw(rng, num, 2, 5) + rng.choice("!#%&*_") + _draw(rng, every, 3, 6)),
    ]
    false = [
        lambda: "AKIA" + rng.choice(["IOSFODNN7EXAMPLE", "XXXXXXXXXXXXXXXX", "0000000000000000", "1234567890123456", "ABCDEFGHIJKLMNOP"]),
        lambda: "ghp_" + rng.choice("xX0a") * 36,
        lambda: "sk-" + "-".join(word() for _ in range(9)) + "-" + word() * 4,
        lambda: rng.choice(["npm_", "hf_"]) + rng.choice("xX0a") * 36,
        lambda: rng.choice(["postgres", "mysql", "https", "amqp"]) + "://user:" + rng.choice(["password", "secret", "changeme", "<pw>", "pass", "xxxx", "your_password", word()]) + "@",
        lambda: "sk_test_" + rng.choice(["x" * 24, "example" * 3, "1234567890123456"]),
        lambda: assigned("".join(rng.choice(words) for _ in range(rng.randint(1, 4)))),
        lambda: assigned(rng.choice(words) + rng.choice("_-.") + rng.choice(words) + rng.choice(["", "_here", "123", "1"])),
        lambda: assigned(rng.choice("xX*0.") * rng.randint(6, 40)),
        lambda: assigned(word() + rng.choice(["", ".", "s", "_" + word()])),
        lambda: assigned("/" + word() + "/" + word() + rng.choice([".txt", ".yaml", "/", ""])),
        lambda: assigned("https://" + word() + ".com/" + word()),
        lambda: assigned("${" + word().upper() + "}"),
        lambda: assigned("os.environ[" + word() + "]"),
        lambda: assigned(_draw(rng, num, 1, 3) + "." + _draw(rng, num, 1, 2) + "." + _draw(rng, num, 1, 3) + "." + _draw(rng, num, 1, 3)),
        lambda: assigned(_draw(rng, hexa, 8) + "-" + _draw(rng, hexa, 4) + "-4" + _draw(rng, hexa, 3) + "-" + _draw(rng, hexa, 4) + "-" + _draw(rng, hexa, 12)),
        lambda: assigned("2024-" + _draw(rng, num, 2) + "-" + _draw(rng, num, 2)),
        lambda: assigned("self." + word() + "." + word()),
    ]
    for k in range(n):
        label = k % 2
        found = rng.choice(true if label else false)()
        near = rng.choice(filler) + " " + (rng.choice(["example", "sample", "dummy", "fake", "for test"]) if rng.random() < (0.03 if label else 0.4) else word())
        out.append((found, near, rng.choice(filler), label))
    return out


class Tree:
    """A classification tree by Gini impurity over random feature subsets."""

    def __init__(self, x, y, rng, depth=7, least=4):
        self.cut = None
        self.value = float(y.mean())
        if depth == 0 or len(y) < 2 * least or self.value in (0.0, 1.0):
            return
        best = None
        for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1])) + 1), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y))
            ok = (v[1:] > v[:-1]) & (n >= least) & (len(y) - n >= least)
            if not ok.any():
                continue
            p, q = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(y) - n)
            loss = np.where(ok, n * p * (1 - p) + (len(y) - n) * q * (1 - q), np.inf)
            k = int(loss.argmin())
            if best is None or loss[k] < best[0]:
                best = loss[k], int(f), float((v[k] + v[k + 1]) / 2)
        if best is None:
            return
        _, f, at = best
        left = x[:, f] <= at
        self.cut = f, at, Tree(x[left], y[left], rng, depth - 1, least), Tree(x[~left], y[~left], rng, depth - 1, least)

    def column(self, features: list[Column]) -> Column:
        if self.cut is None:
            return F.lit(self.value)
        f, at, left, right = self.cut
        return F.when(features[f] <= at, left.column(features)).otherwise(right.column(features))


def forest(x: np.ndarray, y: np.ndarray, trees: int = 15, seed: int = 3) -> list[Tree]:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(Tree(x[rows], y[rows], rng))
    return out


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled findings of a file or folder: Parquet, JSON lines (.json, .jsonl), or CSV with a header (.csv, quoted, lines may break within quotes)."""
    kind, schema = path.rstrip("/").rsplit(".", 1)[-1], "found string, before string, after string, label int"
    if kind in ("json", "jsonl"):
        return spark.read.schema(schema).json(path)
    if kind == "csv":
        return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return spark.read.parquet(path).select("found", "before", "after", F.col("label").cast("int").alias("label"))


def train(spark: SparkSession, labelled: DataFrame | list[tuple[str, str, str, int]] | None = None, words: list[str] = ()) -> list[Tree]:
    """A forest from labelled findings (a table, or rows); rows without a text or label are left out, null neighbours are empty. With none left no candidate is a secret."""
    rows = labelled if isinstance(labelled, DataFrame) else spark.createDataFrame(labelled if labelled is not None else labelled_findings(), "found string, before string, after string, label int")
    rows = rows.where("found is not null and label in (0, 1)").orderBy(F.xxhash64("found", "before", "after", "label")).limit(MOST_LABELLED)
    own = rows.select("found", *(F.coalesce(c, F.lit("")).alias(c) for c in ("before", "after")), "label").withColumn("value", value_of(F.col("found")))
    columns = feature_columns(F.col("value"), F.col("found"), F.col("before"), F.col("after"), words)
    data = np.array([tuple(map(float, r)) for r in own.select(*(columns[k].cast("double").alias(k) for k in FEATURES), "label").collect()])
    return forest(data[:, :-1], data[:, -1]) if len(data) else []


def findings(documents: DataFrame, trees: list[Tree], words: list[str] = ()) -> DataFrame:
    """doc_id, ordinal, kind, start, length, value_sha256, score, is_secret: every candidate of every row, the forest's share of votes and its decision.

    start counts characters from 0. A null or empty text has no candidates. Repeated rows are reported each, a null doc_id as
    null. The candidates of a row are numbered in text order; a very long text is scanned whole. An empty table gives an
    empty table; extra columns are ignored.
    """
    # Only rows with a candidate are split.
    pattern = F.lit(CANDIDATE)
    rows = documents.select(F.col("doc_id").alias("doc_id"), text_column(documents).alias("text")).where(F.col("text").rlike(CANDIDATE))
    cut = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), F.regexp_extract_all("text", pattern, F.lit(0)).alias("found"), F.split("text", CANDIDATE, -1).alias("pieces"))
    near = cut.select("doc_id", "row", "found", F.transform("pieces", lambda p: F.struct(F.length(p).alias("size"), F.right(p, F.lit(CONTEXT)).alias("tail"), F.left(p, F.lit(CONTEXT)).alias("head"))).alias("pieces"))
    one = near.select("doc_id", "row", F.posexplode(F.arrays_zip(F.col("found"), F.slice("pieces", 1, F.size("found")).alias("before"), F.slice("pieces", 2, F.size("found")).alias("after"))).alias("ordinal", "x"))
    flat = one.select("doc_id", "row", "ordinal", F.col("x.found").alias("found"), F.col("x.before.size").alias("gap"), F.coalesce("x.before.tail", F.lit("")).alias("before"), F.coalesce("x.after.head", F.lit("")).alias("after"))
    so_far = Window.partitionBy("row").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    placed = flat.withColumn("end", F.sum(F.col("gap") + F.length("found")).over(so_far)).withColumn("value", value_of(F.col("found")))
    columns = feature_columns(F.col("value"), F.col("found"), F.col("before"), F.col("after"), words)
    featured = placed.select("doc_id", "ordinal", "found", "value", "end", *(columns[k].cast("double").alias(f"f_{k}") for k in FEATURES))
    inputs = [F.col(f"f_{k}") for k in FEATURES]
    score = sum((t.column(inputs) for t in trees), F.lit(0.0)) / max(1, len(trees))
    kind = F.coalesce(*(F.when(F.col("found").rlike(f"^(?:{p})$"), k) for k, p in FORMATS.items()))
    return featured.select("doc_id", "ordinal", kind.alias("kind"), (F.col("end") - F.length("value") - F.when(F.col("found").rlike(f"^(?:{FORMATS['url_password']})$"), 1).otherwise(0)).cast("long").alias("start"), F.length("value").cast("long").alias("length"), F.sha2(F.col("value"), 256).alias("value_sha256"), score.alias("score")).withColumn("is_secret", F.col("score") >= THRESHOLD)


def secret_table(documents: DataFrame, labelled: DataFrame | list[tuple[str, str, str, int]] | None = None) -> DataFrame:
    """findings() with a dictionary counted over all documents and a forest trained on the labelled findings (or drawn ones).

    Null and empty texts count no words and have no candidates; a null doc_id is reported as null, repeated rows are each; an empty table gives an
    empty table; extra columns are ignored.
    """
    words = dictionary(documents)
    return findings(documents, train(documents.sparkSession, labelled, words), words)
