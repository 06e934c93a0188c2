"""Secret scans: broad candidates, and a random forest that removes the false findings.

A candidate is a run of at least 12 characters of keys and tokens with a digit in it (the value
after a ``name=``), the whole value that is assigned to a credential word (quoted, or up to the next
blank; any characters, with or without a digit), or the password of a ``user:password@host``; the last two
from ``MIN_VALUE`` characters on. Candidates may lie in one another. Twelve features describe one: length,
character transitions, entropy, shares of digits, upper case and marks, dictionary coverage (words of a
public vocabulary), marks of paths and addresses, credential and harmless words beside it, hexadecimal
or not, assigned or not. The forest is trained by Spark ML on labelled findings and ships to the tasks
as a few hundred nodes.

Labelled findings: a table (before, candidate, after, label) of the caller's own, or candidates of
the corpus that a strict rule decides (formats of known issuers and values assigned to a credential
name; numbers, addresses, paths and identifiers), at most ``MAX_LABELLED`` of each label, the
ones with the least hash. A few hundred made examples are always added, so that both labels and
hard cases (commit hashes, checksums, identifiers) occur.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillflow.llm.common import fresh, let_slot_go, per_worker, row_slices, stored, trim_worker

MAX_LABELLED = 4_000
TREES, DEPTH, SEED = 25, 6, 17
THRESHOLD = 0.5
MASK = "[SECRET]"
BESIDE = 48

_RUN = re.compile(r"[A-Za-z0-9+/_=.\-]{12,}")
_DIGIT = re.compile(r"[0-9]")
_ASSIGNED = re.compile(r"([A-Za-z][A-Za-z_.\-]{1,40})=(?=.{8})")
MIN_VALUE = 6
_SIGN = re.compile(r"=>|:=|[=:]")
# The name before an assignment sign; a word of its own, also in camel case or joined by marks.
_NAME = re.compile(
    r"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|secret|auth|private)?key"
    r"|(?:auth|access)token|auth(?:orization)?|bearer|credentials?|private|login)s?[\"']?[ \t]{0,4}\Z")
_VALUE = re.compile(
    r"[ \t]{0,4}(?i:(?:bearer|basic)[ \t]+)?(?:\"(?P<double>(?:\\.|[^\"\\\n])+)\"|'(?P<single>(?:\\.|[^'\\\n])+)'"
    r"|[\"']?(?P<bare>(?:(?!&[A-Za-z_][\w.\-]*=)[^\s\"'])(?:(?!&[A-Za-z_][\w.\-]*=)\S)*))")
_USER = re.compile(r"(?:://[^\s/:@]*|(?<![^\s\"'(\[<])(?!mailto:)[\w.+\-]+):\Z")
_PASSWORD = re.compile(r"([^\s/]+)@(?=[A-Za-z0-9\[])")
_WORD = re.compile(r"[A-Za-z][A-Za-z0-9_]*")
# Formats of known issuers.
_ISSUED = re.compile(
    r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_\-]{20,}|xox[abprs]-[A-Za-z0-9\-]{10,}"
    r"|AIza[A-Za-z0-9_\-]{35}|[sr]k_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_.\-]{8,}")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_NUMBERS = re.compile(r"[0-9+/_=.\-]+")
CREDENTIAL_WORDS = frozenset(
    "password passwd pwd pass secret token apikey api_key key auth bearer credential credentials "
    "access_key secret_key private client_secret access_token auth_token login".split())
HARMLESS_WORDS = frozenset(
    "commit sha sha1 sha256 md5 checksum hash digest revision uuid guid id version isbn issn doi order "
    "invoice phone tel page figure build release etag session file path url ref".split())

FEATURES = ("length", "transitions", "entropy", "digits", "upper", "dictionary", "path", "credential", "harmless",
            "hexadecimal", "marks", "assigned")
FINDING = ("doc_id long, start long, end long, secret_sha256 string, votes double, is_secret boolean")


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the candidates of a text, in code points, in order."""
    return sorted({*_runs(text), *_values(text)})


def _runs(text: str) -> Iterator[tuple[int, int]]:
    for m in _RUN.finditer(text):
        run = m.group()
        if not _DIGIT.search(run):
            continue
        start, end = m.span()
        named = _ASSIGNED.match(run)
        if named:
            start += named.end()
        while end > start and text[end - 1] in ".-":
            end -= 1
        if end - start >= 8 and _DIGIT.search(text, start, end):
            yield start, end


def _values(text: str) -> Iterator[tuple[int, int]]:
    """Values assigned to a credential word, and passwords before a host."""
    for sign in _SIGN.finditer(text):
        start, end = 0, 0
        before = text[max(0, sign.start() - BESIDE):sign.end()]
        if before[-1] == ":" and _USER.search(before):
            found = _PASSWORD.match(text, sign.end())
            if found:
                start, end = found.span(1)
        if not end and _NAME.search(text[max(0, sign.start() - BESIDE):sign.start()]):
            found = _VALUE.match(text, sign.end())
            if found:
                start, end = found.span(found.lastgroup)
                while found.lastgroup == "bare" and end > start and text[end - 1] in ",;.)]}\"'":
                    end -= 1
        if end - start >= MIN_VALUE:
            yield start, end


def _assigned(before: str, after: str) -> bool:
    """Whether a value between these texts is assigned to a credential word, or a password before a host."""
    if after[:1] == "@" and _USER.search(before):
        return True
    name = re.sub(r"(?i:[ \t](?:bearer|basic)[ \t]+)\Z", "", before.rstrip("\"'")).rstrip(" \t")
    sign = re.search(r"(?:=>|:=|[=:])\Z", name)
    return bool(sign and _NAME.search(name[:sign.start()]))


def dictionary(path: str) -> frozenset[str]:
    """Whole words of three letters or more of a vocabulary that marks the end of words."""
    import json

    with open(path, encoding="utf-8") as file:
        vocab = json.load(file)["model"]["vocab"]
    return frozenset(w[:-4] for w in vocab if w.endswith("</w>") and len(w) >= 7 and w[:-4].isascii() and w[:-4].isalpha())


def covered(text: str, words: frozenset[str]) -> float:
    """Share of the letters that dictionary words cover, longest words first from the left."""
    letters = hit = 0
    for run in re.findall(r"[a-z]+", text.lower()):
        letters += len(run)
        i = 0
        while i < len(run):
            size = next((n for n in range(min(14, len(run) - i), 2, -1) if run[i:i + n] in words), 0)
            hit += size
            i += size or 1
    return hit / letters if letters else 0.0


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def features(before: str, value: str, after: str, words: frozenset[str]) -> list[float]:
    n = len(value)
    kinds = [_kind(c) for c in value]
    counts = [value.count(c) for c in set(value)]
    beside = [w.lower() for w in _WORD.findall(before)[-4:]]
    near = set(beside) | {p for w in beside for p in w.split("_")}
    assigned = _assigned(before, after)
    address = not assigned and ("://" in before[-12:] or "@" in before[-1:] + after[:1])
    marks = sum(value.count(c) for c in "/.") + 2 * address
    return [
        math.log2(n), sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1),
        -sum(c / n * math.log2(c / n) for c in counts), kinds.count(0) / n, kinds.count(2) / n,
        covered(value, words), float(marks), float(bool(near & CREDENTIAL_WORDS)),
        float(bool(near & HARMLESS_WORDS)), float(all(c in "0123456789abcdefABCDEF" for c in value)),
        kinds.count(3) / n, float(assigned)]


def sure_label(before: str, value: str, after: str) -> int | None:
    """1 or 0 where a strict rule decides, else None."""
    beside = {w.lower() for w in _WORD.findall(before)[-2:]}
    if _ISSUED.fullmatch(value):
        return 1
    if after[:1] == "@" and _USER.search(before):
        return 1 if _DIGIT.search(value) and "://" in before else None
    if (_NUMBERS.fullmatch(value) or _UUID.fullmatch(value) or "://" in before[-12:]
            or "@" in before[-1:] + after[:1] or beside & HARMLESS_WORDS):
        return 0
    assigned = before.rstrip(" \"'")[-1:] in ("=", ":")
    # A value without a digit may be an ordinary word.
    return 1 if assigned and beside & CREDENTIAL_WORDS and _DIGIT.search(value) and " " not in value else None


def made_findings(count: int = 40, seed: int = SEED) -> list[tuple[str, str, str, int]]:
    """Made examples: ``count`` of each kind."""
    rnd = random.Random(seed)
    pick = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    hexa, upper, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", (
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    out = []
    for _ in range(count):
        named = rnd.choice(["password", "api_key", "secret", "auth_token", "access_key", "token"])
        strong = pick(mixed, rnd.randint(5, 12)) + rnd.choice("!&#$%?*") + pick(mixed + "!&#$%?*", rnd.randint(1, 5))
        letters, lower = mixed[:-10], mixed[26:-10]
        plain = "".join(rnd.choice("bcdfghklmnprstvw") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 4)))
        prose = rnd.choice("required optional string missing changed incorrect forgotten protected another everything "
                           "nothing function undefined different important available successful".split())
        blank = rnd.choice(["<your password>", "${DB_PASSWORD}", "********", "{{ secret }}", "<secret>", "$PASSWORD", "%(token)s",
                            "xxxxxxxx", "os.environ['TOKEN']", "getpass.getpass()", "your-password-here"])
        out += [
            (f'{named} = "', strong, '"', 1), (f"with {named}=", strong, " and more", 1),
            (f"{named}: ", rnd.choice([plain, prose]) + str(rnd.randint(10, 9999)), ", then", 1),
            (f'{named} = "', pick(letters, rnd.randint(12, 32)), '"', 1),
            (f"{named}: ", pick(lower, rnd.randint(8, 20)), " and more", 1),
            (f"at {rnd.choice(['postgres', 'mysql', 'https', 'amqp'])}://{plain}:",
             rnd.choice([strong, pick(mixed, 12) + "9", pick(lower, 10)]), f"@{prose}.example.com/db", 1),
            (f"{named}: ", prose, rnd.choice([" and more", ", but"]), 0), (f'{named} = "', prose, '"', 0),
            (f"the {rnd.choice([named, 'key', 'pass', 'login'])}: ", prose, " words", 0),
            (rnd.choice([f"{named}: ", f'{named} = "', f"{named}="]), blank, "", 0),
            ("write to ", f"{plain}.{prose}{rnd.randint(10, 99)}", f"@{prose}.example.com today", 0),
            (f"set {named}=", pick(hexa, rnd.randint(16, 40)) + "7", "", 1),
            (f'the {named} = "', pick(mixed, rnd.randint(16, 44)) + "3", '"', 1),
            ("some words and ", "AKIA" + pick(upper, 16), " more words", 1),
            ("some words and ", "ghp_" + pick(mixed, 36), " more words", 1),
            ("words around ", pick(mixed, rnd.randint(28, 44)) + "5", " and more", 1),
            ("see commit ", pick(hexa, 40), " for this", 0),
            ("sha256 checksum ", pick(hexa, 64), " of the file", 0),
            ("with the id ", "-".join(pick(hexa, n) for n in (8, 4, 4, 4, 12)), " in it", 0),
            ("read ", f"/home/user/project/file{rnd.randint(1, 99)}.txt", " first", 0),
            ("at https://", f"www.example.com/pages/{rnd.randint(1, 9999)}/index.html", " today", 0),
            ("call ", "".join(rnd.choice("0123456789") for _ in range(rnd.randint(12, 19))), " now", 0),
            ("version ", f"release-{rnd.randint(1, 9)}.{rnd.randint(0, 30)}.{rnd.randint(0, 30)}-beta", " is out", 0),
            ("in the ", rnd.choice(["chapter", "section", "question", "experiment"]) + f"-{rnd.randint(1, 400)}-overview",
             " of it", 0),
            ("from ", ".".join(str(rnd.randint(10, 255)) for _ in range(4)), " again", 0),
        ]
    return out


class Forest:
    """Trees as arrays; ``votes`` gives the share of trees that say "secret"."""

    def __init__(self, trees: list[list[tuple[int, float, int, int, float]]]):
        self.trees = [tuple(np.array(c) for c in zip(*tree)) for tree in trees]

    def votes(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for feature, threshold, left, right, leaf in self.trees:
            node = np.zeros(len(rows), np.int64)
            while (inner := feature[node] >= 0).any():
                value = rows[np.arange(len(rows)), np.maximum(feature[node], 0)]
                node = np.where(inner, np.where(value <= threshold[node], left[node], right[node]), node)
            total += leaf[node]
        return total / max(1, len(self.trees))


def parse_tree(text: str) -> list[tuple[int, float, int, int, float]]:
    """The nodes (feature or -1, threshold, left, right, prediction) of a tree's printed form."""
    lines = iter(line.strip() for line in text.splitlines() if re.match(r"\s*(If|Else|Predict)", line))
    nodes: list = []

    def read() -> int:
        at, line = len(nodes), next(lines)
        nodes.append(None)
        if line.startswith("Predict"):
            nodes[at] = (-1, 0.0, at, at, float(line.split(":")[1]))
        else:
            m = re.match(r"If \(feature (\d+) <= ([-+0-9.eE]+)\)", line)
            left = read()
            next(lines)  # the matching Else
            nodes[at] = (int(m.group(1)), float(m.group(2)), left, read(), 0.0)
        return at

    read()
    return nodes


def _scan_batches(path: str, visit):
    """Run ``visit(doc_id, text, start, end, words)`` over the candidates of each batch."""
    let_slot_go("vocabulary")
    words = per_worker("dictionary", (path,), lambda: dictionary(path))

    def rows(batch):
        for part in row_slices(batch):
            for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                for start, end in candidates(text or ""):
                    yield visit(name, text, start, end, words)

    return rows


def _around(text: str, start: int, end: int) -> tuple[str, str, str]:
    return text[max(0, start - BESIDE):start], text[start:end], text[end:end + BESIDE]


def labelled_findings(docs: DataFrame, path: str, limit: int = MAX_LABELLED) -> DataFrame:
    """(features, label) of candidates that a strict rule decides: ``limit`` of each label at most."""
    schema = pa.schema([("hash", pa.int64()), ("label", pa.int32()), ("features", pa.list_(pa.float64()))])

    def run(batches):
        def visit(name, text, start, end, words):
            around = _around(text, start, end)
            label = sure_label(*around)
            if label is None:
                return None
            digest = hashlib.blake2b(f"{name}:{start}:{around[1]}".encode(), digest_size=8).digest()
            return int.from_bytes(digest, "little", signed=True), label, features(*around, words)

        rows = _scan_batches(path, visit)
        for batch in batches:
            found = [r for r in rows(batch) if r is not None]
            columns = zip(*found) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)
        trim_worker()

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "hash long, label int, features array<double>")
    # The least hashes of each label: first of each of 32 shares, so that few rows meet in the end.
    share = Window.partitionBy("label", F.pmod("hash", F.lit(32))).orderBy("hash")
    order = Window.partitionBy("label").orderBy("hash")
    for window in (share, order):
        found = found.withColumn("nth", F.row_number().over(window)).where(F.col("nth") <= limit).drop("nth")
    return found.select("features", "label")


def train(docs: DataFrame, path: str, labelled: DataFrame | None = None, limit: int = MAX_LABELLED) -> Forest:
    """The forest, trained on labelled findings of the caller (before, candidate, after, label) or of ``docs``.

    ``path``: the vocabulary file whose words are the dictionary. Works for an empty corpus, too.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    spark, words = docs.sparkSession, dictionary(path)
    rows = made_findings()
    if labelled is not None:
        rows += [tuple(r) for r in labelled.select("before", "candidate", "after", "label").limit(limit).collect()]
    made = spark.createDataFrame([(features(b, v, a, words), label) for b, v, a, label in rows],
                                 "features array<double>, label int")
    table = made if labelled is not None else made.unionByName(labelled_findings(docs, path, limit))
    # At most 2 * limit rows and the made ones; written, as training reads them several times.
    rows = stored(table, "labelled").select(
        array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"))
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(rows.coalesce(2))
    return Forest([parse_tree(tree.toDebugString) for tree in model.trees])


def scan(docs: DataFrame, forest: Forest, path: str, threshold: float = THRESHOLD) -> DataFrame:
    """One row per candidate of every text of ``docs`` (doc_id, text), with the verdict of the forest.

    doc_id, start and end (code points), secret_sha256 (of the candidate, which itself isn't
    repeated), votes, is_secret. Null and empty texts have no candidates, repeated rows repeat
    their findings, other columns are ignored. No shuffle.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
                        ("secret_sha256", pa.string()), ("votes", pa.float64()), ("is_secret", pa.bool_())])

    def run(batches):
        def visit(name, text, start, end, words):
            around = _around(text, start, end)
            return (name, start, end, hashlib.sha256(around[1].encode()).hexdigest()), features(*around, words)

        rows = _scan_batches(path, visit)
        for batch in batches:
            found = list(rows(batch))
            votes = forest.votes(np.array([f for _, f in found])) if found else np.empty(0)
            columns = [*(zip(*(r for r, _ in found)) if found else ([], [], [], [])), votes, votes >= threshold]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)
        trim_worker()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FINDING)


def _joined(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, with those that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def redact(docs: DataFrame, forest: Forest, path: str, threshold: float = THRESHOLD, mask: str = MASK) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask``; ``n_chars`` follows the text if it is there.

    All rows and columns stay, null texts stay null, nothing is shuffled.
    """

    # Only the texts that change come back from Python.
    @F.arrow_udf("string")
    def masked(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        let_slot_go("vocabulary")
        words = per_worker("dictionary", (path,), lambda: dictionary(path))
        for texts in columns:
            out = []
            for start in range(0, len(texts), 256):
                for text in texts.slice(start, 256).to_pylist():
                    spans = candidates(text or "")
                    if spans:
                        votes = forest.votes(np.array([features(*_around(text, a, b), words) for a, b in spans]))
                        spans = _joined(span for span, vote in zip(spans, votes) if vote >= threshold)
                    parts, done = [], 0
                    for a, b in spans:
                        parts += [text[done:a], mask]
                        done = b
                    out.append("".join(parts) + text[done:] if spans else None)
            yield pa.array(out, pa.string())
        trim_worker()

    (name,) = fresh(docs, "masked")
    out = docs.withColumn(name, masked(docs["text"]))
    changed = F.col(name).isNotNull() & (F.col(name) != docs["text"])
    new = {"text": F.coalesce(F.col(name), docs["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(name)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(new).drop(name)
