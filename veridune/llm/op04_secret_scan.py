"""Secret scans: pattern candidates, and a random forest that removes false findings.

Candidates are tokens of at least 16 characters of the usual key alphabets that hold a digit and a letter or start as known
keys do, values of any length and alphabet that a credential word assigns or announces, and private keys in PEM form.  The forest sees their length, character classes and transitions, likelihood under a character-pair model of ordinary words, coverage by a word
list, the path (or source) they come from and the words beside them.  It is trained from labelled findings: a table
(text, start, end, path, is_secret), at most ``MOST_FINDINGS`` rows of it in hash order; without one, from generated findings
with a fixed seed.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .forest import Forest

MOST_FINDINGS = 20_000
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_-]{16,}={0,2}")
ASSIGNED = re.compile(
    rb"""(?:token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|credentials?|bearer)[\w-]{0,40}["'`]?\]?"""
    rb"""(?:[ \t]*(?:=>|:=|==|=|:)[ \t]*|[ \t]+(?=["'`])|(?<=bearer)[ \t]+)(?:bearer[ \t]+)?(?:"((?:[^"\\\r\n]|\\.)+)"|'((?:[^'\\\r\n]|\\.)+)'|`([^`\r\n]+)`|([^\s"'`]\S*))""",
    re.I,
)
PEM = re.compile(rb"-----BEGIN ([A-Z ]*PRIVATE KEY)-----.*?-----END \1-----", re.S)
NEAR = 48  # bytes looked at on either side
WORDS = """about access account after again also application array before between block build button cache call change check child class
client code color column common config connect container content context control count create current custom data database date
default delete design device dialog display document domain driver editor element email enable engine entity error event example
feature field file filter first folder form format function global group handler header height home html http image import index
info input insert instance item json language layout length letter library line link list load local lock login main manager
master matrix memory message method model module monitor name network node null number object open option order output package
page panel param parent path pattern player plugin point policy print process product profile project property public query
queue reader record region release remote render report request resource response result return role route sample schema screen
script search section select server service session setting setup simple size source stack start state status stream string
style submit switch system table target template test text theme thread time title toggle tool tree type update upload user value
version video view visible watch widget width window word world write your""".split()
HINTS = re.compile(rb"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|credential|bearer)\W{0,4}$", re.I)
BENIGN = re.compile(rb"(?:commit|sha(?:1|256)?|md5|checksum|digest|hash|uuid|id|ref|rev|version|example|sample|dummy|placeholder|url|href|src)\W{0,4}$", re.I)
PREFIX = re.compile(rb"^(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|xox[abprs]-|sk_live_|rk_live_|AIza|eyJ|glpat-|npm_)")
TEST_PATH = re.compile(r"test|spec|example|sample|fixture|doc|mock|readme", re.I)
_WORD = re.compile("|".join(sorted(WORDS, key=len, reverse=True)), re.I)


def _pairs() -> np.ndarray:
    """Log-likelihoods of character pairs in ordinary words."""
    n = np.full((27, 27), 0.5)
    for w in WORDS:
        x = [ord(c) - 97 for c in w]
        for a, b in zip([26, *x], [*x, 26], strict=True):
            n[a, b] += 1
    return np.log(n / n.sum(axis=1, keepdims=True))


_PAIRS = _pairs()


def features(text: bytes, start: int, end: int, path: str | None) -> list[float]:
    c = text[start:end]
    s = c.decode("ascii", "replace")
    n = len(s)
    kinds = [0 if x.isdigit() else 1 if x.islower() else 2 if x.isupper() else 3 for x in s]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    counts = np.bincount(kinds, minlength=4)
    freq: dict[str, int] = {}
    for x in s:
        freq[x] = freq.get(x, 0) + 1
    entropy = -sum(v / n * math.log2(v / n) for v in freq.values())
    letters = [ord(x) - 97 for x in s.lower() if "a" <= x <= "z"]
    like = sum(_PAIRS[a, b] for a, b in zip(letters, letters[1:], strict=False)) / max(1, len(letters) - 1)
    covered = sum(m.end() - m.start() for m in _WORD.finditer(s) if m.end() - m.start() >= 4) / n
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    runs = max((len(m.group()) for m in re.finditer(r"(.)\1*", s)), default=0)
    hexes = sum(x in "0123456789abcdefABCDEF" for x in s) / n
    parts = [p for p in re.split(r"[-_/+=]", s) if p]
    return [
        n, entropy, turns / n, counts[0] / n, counts[1] / n, counts[2] / n, counts[3] / n, like, covered, runs / n, hexes,
        len(parts), max(map(len, parts), default=0) / n, float(bool(PREFIX.search(c))), float(bool(HINTS.search(before))), float(bool(BENIGN.search(before))),
        float(b"=" in before[-4:] or b":" in before[-4:]), float(before[-1:] in (b'"', b"'", b"`")), float(after[:1] in (b'"', b"'", b"`")),
        float(b"://" in before or b"/" in before[-1:]), float(bool(re.search(rb"[A-Za-z]{2,} [A-Za-z]{2,}\W*$", before))), float(bool(TEST_PATH.search(path or ""))), len(freq) / n,
    ]


def assigned(text: bytes) -> Iterator[tuple[int, int]]:
    """Values behind credential words, and private keys in PEM form."""
    for m in ASSIGNED.finditer(text):
        a, b = m.span(m.lastindex)
        if m.lastindex == 4:
            b = a + len(text[a:b].rstrip(b"\"'`,;)]}>"))
        if a < b:
            yield a, b
    for m in PEM.finditer(text):
        yield m.span()


def candidates(text: bytes) -> Iterator[tuple[int, int]]:
    yield from sorted({*_tokens(text), *assigned(text)})


def _tokens(text: bytes) -> Iterator[tuple[int, int]]:
    for m in CANDIDATE.finditer(text):
        c = m.group().strip(b"-_=/+")
        if len(c) >= 16 and (PREFIX.search(c) or any(48 <= x <= 57 for x in c) and any(65 <= x <= 90 or 97 <= x <= 122 for x in c)):
            a = m.start() + m.group().index(c)
            yield a, a + len(c)


def generated_findings(n: int = 6000, seed: int = 11) -> list[tuple[bytes, int, int, str, int]]:
    """Labelled findings by rule: keys and passwords in assignments, tokens with known prefixes, private keys; and the usual false ones."""
    r = random.Random(seed)
    pick = lambda a, k: "".join(r.choice(a) for _ in range(k))
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    prose = lambda k: " ".join(r.choice(WORDS) if r.random() < 0.5 else pick("aeioustnrhdl", r.randint(2, 9)) for _ in range(k))
    words = lambda k, sep: sep.join(r.choice(WORDS) for _ in range(k))
    odd = "!@#$%^&*.?-_"
    leet = str.maketrans("aeiost", "4310$7")
    names = ["token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "ACCESS_KEY", "auth_token", "private_key", "client_secret", "Password"]

    def made() -> tuple[bytes, int, int, str, int]:
        """An assigned value of any alphabet, or a private key."""
        secret, kind = r.random() < 0.5, r.random()
        path = r.choice(["src/app.py", "config/prod.env", "src1", "src12", "deploy.yml"])
        quote = r.choice(['"', '"', "'", ""])
        lead = r.choice(names) + r.choice([" = ", "=", ": ", ":", '": ']) + quote
        if secret and kind < 0.12:
            name = r.choice(["RSA ", "EC ", "", "OPENSSH "]) + "PRIVATE KEY"
            lines = [pick(alnum + "+/", 64) for _ in range(r.randint(2, 24))] + [pick(alnum + "+/", r.randint(10, 62)) + "=="]
            lead, quote, body = "", "", f"-----BEGIN {name}-----\n" + "\n".join(lines) + f"\n-----END {name}-----"
        elif secret:
            body = r.choice([
                lambda: words(1, "").title().translate(leet) + pick(odd, r.randint(1, 2)) + pick("0123456789", r.randint(1, 4)) + pick(odd, r.randint(0, 1)),
                lambda: "".join(x.translate(leet) if r.random() < 0.5 else x for x in pick("aeioustnrhdl", r.randint(5, 9)).title()) + pick(odd, 1) + pick(alnum, r.randint(1, 4)) + pick(odd, 1),
                lambda: pick(alnum + odd, r.randint(8, 24)), lambda: pick(alnum, r.randint(8, 15)), lambda: pick(alnum[:52], r.randint(10, 40)), lambda: pick(alnum[26:52], r.randint(12, 40)),
                lambda: pick(hexa, r.choice([8, 12, 16, 24])), lambda: r.choice(WORDS) + pick("0123456789", r.randint(2, 5)) + pick(odd, r.randint(0, 2)), lambda: pick("aeioustnrhdl", r.randint(4, 7)) + pick("0123456789", r.randint(1, 4)),
            ])()
        else:
            body = r.choice([
                lambda: words(1, ""), lambda: words(2, "."), lambda: words(2, "_"), lambda: words(2, "_").upper(), lambda: words(1, "") + "()", lambda: words(2, ".") + "(" + words(1, "") + ")", lambda: "${" + words(2, "_").upper() + "}",
                lambda: "<" + words(2, "-") + ">", lambda: "{{ " + words(1, "") + " }}", lambda: r.choice("*x.") * r.randint(3, 16), lambda: r.choice(["None", "null", "true", "false", "required", "string", "str", "undefined", "changeme", "your_password_here", "int", "..."]),
                lambda: pick("aeioustnrhdl", r.randint(2, 9)), lambda: prose(r.randint(2, 5)) if quote else prose(1), lambda: "os.environ[" + words(1, "").upper() + "]", lambda: "http://" + words(2, ".") + "/" + words(1, ""), lambda: pick("0123456789", r.randint(1, 3)),
            ])()
        a = prose(r.randint(1, 6)) + " " + lead
        return (a + body + quote + " " + prose(r.randint(1, 5))).encode(), len(a.encode()), len((a + body).encode()), path, int(secret)

    out = []
    for i in range(n):
        if i % 5 == 4:
            out.append(made())
            continue
        secret = i % 2
        if secret:
            body = r.choice([lambda: pick(hexa, r.choice([32, 40, 40, 64])), lambda: pick(alnum, r.randint(20, 48)), lambda: pick(alnum + "+/", r.choice([40, 44, 64])), lambda: r.choice(["AKIA", "ghp_", "sk_live_", "xoxb-", "AIza", "glpat-"]) + pick(alnum, r.randint(16, 36))])()
            lead = r.choice(["token", "secret", "password", "api_key", "apikey", "ACCESS_KEY", "auth_token", "private_key", "client_secret", "Bearer"]) + r.choice([" = ", "=", ": ", ":", " "])
            if body[:4] in ("AKIA", "ghp_", "glpa", "xoxb") and r.random() < 0.3:
                lead = ""
            quote = r.choice(['"', '"', "'", ""])
            path = r.choice(["src/app.py", "config/prod.env", "src1", "src12", "deploy.yml"])
        else:
            body = r.choice([
                lambda: words(3, "_") + str(r.randint(1, 999)), lambda: words(4, "-") + "-" + str(r.randint(2000, 2030)), lambda: words(2, "/") + "/" + words(1, "") + str(r.randint(1, 99)) + "/index",
                lambda: pick(hexa, 8) + "-" + "-".join(pick(hexa, 4) for _ in range(3)) + "-" + pick(hexa, 12), lambda: pick(hexa, r.choice([32, 40, 64])), lambda: "x" * r.randint(12, 20) + str(r.randint(1000, 9999)),
                lambda: "".join(w.title() for w in r.sample(WORDS, 3)) + str(r.randint(1, 99)), lambda: "1234567890abcdef" * r.randint(1, 3),
            ])()
            lead = r.choice(["commit ", "sha256:", "md5 ", "uuid=", "id: ", "url(", "href=", "version ", "", "", "checksum: "])
            quote = r.choice(["", "", '"'])
            path = r.choice(["tests/fixtures.py", "docs/readme.md", "src/app.py", "src3", "examples/a.js"])
        a = prose(r.randint(1, 6)) + " " + lead + quote
        t = (a + body + quote + " " + prose(r.randint(1, 5))).encode()
        out.append((t, len(a.encode()), len(a.encode()) + len(body), path, secret))
    return out


def train(findings: list[tuple[bytes, int, int, str, int]], **options) -> Forest:
    x = np.array([features(t, a, b, p) for t, a, b, p, _ in findings])
    return Forest(**options).fit(x, np.array([f[4] for f in findings], float))


def model_from(findings: DataFrame | None = None) -> Forest:
    if findings is None:
        return train(generated_findings())
    rows = findings.where("is_secret is not null and text is not null and start >= 0 and end > start").orderBy(F.xxhash64("text", "start", "end")).limit(MOST_FINDINGS).collect()
    if not rows:
        return train(generated_findings())
    return train([(r.text.encode(), r.start, r.end, r.path, int(r.is_secret)) for r in rows])


def _judge(text: bytes, path: str | None, model: Forest, threshold: float) -> list[tuple[int, int, float]]:
    at = list(candidates(text))
    if not at:
        return []
    p = model.predict(np.array([features(text, a, b, path) for a, b in at]))
    out: list[tuple[int, int, float]] = []
    for (a, b), x in zip(at, p, strict=True):
        if x < threshold:
            continue
        if out and a < out[-1][1]:  # a token inside an assigned value
            a, b, x = out[-1][0], max(b, out[-1][1]), max(x, out.pop()[2])
        out.append((a, b, float(x)))
    return out


def _scan(shared, threshold: float):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spans = [], []
            for d, t, p in zip(batch["id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), batch["path"].to_pylist(), strict=True):
                for a, b, x in _judge(t or b"", p, shared.value, threshold):
                    ids.append(d)
                    spans.append((a, b, x, "".join("9" if chr(c).isdigit() else "a" if chr(c).islower() else "A" if chr(c).isupper() else chr(c) for c in t[a : a + 4])))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s[0] for s in spans], pa.int64()), pa.array([s[1] for s in spans], pa.int64()), pa.array([round(s[2], 6) for s in spans], pa.float64()), pa.array([s[3] for s in spans], pa.string())], names=["id", "start", "end", "score", "shape"])

    return rows


def _redact(shared, threshold: float, mark: bytes):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, p in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["path"].to_pylist(), strict=True):
                if t:
                    for a, b, _ in reversed(_judge(t, p, shared.value, threshold)):
                        t = t[:a] + mark + t[b:]
                out.append(t)
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(out, pa.binary()).cast(pa.string())], names=["doc", "clean"])

    return rows


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = "source", findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """A row a secret found: id_col, start and end (bytes of the UTF-8 text), score (share of trees), shape (its first characters' classes).

    Null or empty texts hold none; a null path is an unknown one; a null id comes back null; repeated rows are scanned each;
    findings that overlap are one, with the greatest score.  Texts may have any length; further columns, of whatever names,
    are left out.  An empty table of findings, or none of them labelled, is as none.  Empty table: empty result.
    """
    spark = docs.sparkSession
    store.ship(spark)
    model = spark.sparkContext.broadcast(model_from(findings))
    source = F.col(path).cast("string") if path and path in docs.columns else F.lit(None).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"), source.alias("path"))
    out = src.mapInArrow(_scan(model, threshold), "id long, start long, end long, score double, shape string")
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out


def redact(docs: DataFrame, text: str = "text", path: str | None = "source", findings: DataFrame | None = None, threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """docs, all columns whatever their names, with every secret that secret_scan finds in ``text`` replaced by ``mark``; null stays null."""
    from pyspark.sql.types import StringType, StructField, StructType

    spark = docs.sparkSession
    store.ship(spark)
    model = spark.sparkContext.broadcast(model_from(findings))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(0).alias("none")]).alias("doc")
    source = F.col(f"`{path}`").cast("string") if path and path in docs.columns else F.lit(None).cast("string")
    src = docs.select(whole, F.col(f"`{text}`").cast("string").alias("text"), source.alias("path"))
    out = src.mapInArrow(_redact(model, threshold, mark.encode()), StructType([src.schema["doc"], StructField("clean", StringType())]))
    return out.select(*[F.col("clean").alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns])


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
