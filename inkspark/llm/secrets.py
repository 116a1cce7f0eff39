"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

One first-order model learns random strings, the other ordinary identifiers. A run of 16 or more letters, digits and
``+/_=-`` is a secret where the mean log-likelihood ratio of its characters is above a threshold, or else the best of its
stretches between two separators is. Both models are trained here, on labelled samples: the values that the fixed patterns mark in a bounded sample
of the texts, with drawn strings over the alphabets of common keys, against words, joined words and numbers.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import bounded, chunks
from ._scan import Block, Found, byte_class, scan

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "random"]
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = byte_class("0123456789abcdef")
RUN_CHARS = string.ascii_letters + string.digits + "+/_=-"
RUN = byte_class(RUN_CHARS)
LEAST_RUN = 16
SEPARATOR = byte_class("+/_=-")
#: Texts that the models are trained on, bytes of them, and characters of each kind of label taken from them, at most.
SAMPLE_TEXTS, SAMPLE_BYTES, SAMPLE_CHARS = 400, 8 << 20, 400_000
# Words that names in programs are joined of.
CODE_WORDS = (
    "access account add address admin all api app array auth base body buffer build by cache call check class clear client close code config connection content context copy count create current data date "
    "default delete edit end error event exception file filter find first flag format from function get group handler hash header host id image index info init input insert instance item key last "
    "length level line link list load local lock log main manager map max member message method min mode model module name new next node number object open option order output page param "
    "parent parse path port post process product query queue read record remove render request reset response result role root row run save search select send server service session set size sort "
    "source start state status stop string system table tag target task temp test text time title to token total type update upload url user value version view width with write"
).split()
#: Nats a character by which the model of random strings must be better. On held-out labels (600 drawn keys of three alphabets,
#: 605 names of words kept from the training) all keys are found, and 14 names at 0.5, 10 at 0.65, 5 at 0.8.
MARGIN = 0.8


def base_spans(block: Block) -> Found:
    lower = block.data.lower()
    starts = [k for word in ASSIGN_WORDS for k in block.finds(word, lower)]
    out = [("assign", *m.span()) for m in block.matches(ASSIGN, starts) if m.end() - m.start(1) >= 6]
    out += [("access", *m.span()) for m in block.matches(ACCESS, block.finds(b"AKIA")) if m.end() - m.start() >= 20]
    return out + [("hex", *x) for x in block.runs(HEX, 24)]


def labelled(texts: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Random strings and ordinary identifiers; what neither the patterns nor the word shape decides has no label."""
    block = Block(texts)
    spans = base_spans(block)
    found = sorted(re.split(rb"[=: \"']+", block.data[a:b])[-1] for _, a, b in spans)
    draw = random.Random(4)
    alphabets = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789abcdef", string.ascii_uppercase + "234567", string.ascii_lowercase + string.digits]
    secret = [w for w in found if len(w) >= LEAST_RUN]
    secret += ["".join(draw.choices(a, k=draw.randint(20, 40))).encode() for _ in range(1500) for a in alphabets]
    clean = bytearray(block.data)
    for _, a, b in spans:
        clean[a:b] = b" " * (b - a)
    words = sorted(set(re.findall(rb"(?<![\w\x80-\xff])[A-Za-z]{2,24}(?![\w\x80-\xff])", bytes(clean))))
    draw.shuffle(words)
    plain, size = [], 0
    for k, w in enumerate(words):
        if size >= SAMPLE_CHARS:
            break
        v = words[k - 1]
        plain += [w, (w + b"_" + v).lower(), w.lower() + v.title(), (w + b"-" + v + b"-%d" % draw.randrange(1000)).lower(), (w + b"_" + v).upper(), w + b"/" + v, b"%s%d" % (w, draw.randrange(100))]
        size += 7 * len(w)
    plain += _identifiers(draw)
    plain += [b"%d" % draw.randrange(10**12, 10**19) for _ in range(2000)] + [b"%04d-%02d-%02d" % (draw.randrange(1970, 2040), draw.randrange(1, 13), draw.randrange(1, 29)) for _ in range(2000)]
    return secret, plain


def _identifiers(draw: random.Random) -> list[bytes]:
    """Names of programs: joined words in the usual spellings, with numbers among them, and runs of an alphabet."""
    out = []
    for _ in range(6000):
        words = draw.choices(CODE_WORDS, k=draw.randint(2, 6))
        if draw.random() < 0.3:
            words.insert(draw.randint(1, len(words)), str(draw.randrange(100)))
        camel = words[0] + "".join(w.title() for w in words[1:])
        out.append(draw.choice([camel, camel, camel[:1].upper() + camel[1:], "_".join(words), "-".join(words), "_".join(words).upper(), "/".join(words)]))
    for letters in (string.ascii_lowercase, string.ascii_uppercase, string.digits * 3, "qwertyuiopasdfghjklzxcvbnm"):
        for _ in range(150):
            at = draw.randrange(len(letters) - 8)
            out.append(letters[at : at + draw.randint(8, 26)] + draw.choice(["", "123", "123456", "1234567890", string.digits]))
    return [x.encode() for x in out]


def ratios(secret: list[bytes], plain: list[bytes]) -> np.ndarray:
    """Log-likelihood ratio (nats) of each pair of bytes, float64[256, 256]; pairs start with a blank."""
    logs = []
    alphabet = np.flatnonzero(RUN)
    for words in (secret, plain):
        data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
        counts = np.zeros((256, 256))
        np.add.at(counts, (data[:-1], data[1:]), 1)
        counts = counts[:, alphabet]
        order0 = (counts.sum(0) + 1) / (counts.sum() + len(alphabet))
        # the pair counts are backed by 8 draws from the characters' own shares, so rare pairs stay finite
        logs.append(np.log((counts + 8 * order0) / (counts.sum(1, keepdims=True) + 8)))
    out = np.zeros((256, 256))
    out[:, alphabet] = logs[0] - logs[1]
    return out


def random_runs(block: Block, ratio: np.ndarray, margin: float = MARGIN) -> Found:
    """Stretches of runs, from separator to separator, whose characters are above the margin by most in sum."""
    out, data = [], block.bytes
    gain = np.zeros(len(data))
    gain[1:] = ratio[data[:-1], data[1:]]
    total = np.concatenate([[0], np.cumsum(gain - margin)])
    cut = SEPARATOR[data]
    for a, b in block.runs(RUN, LEAST_RUN):
        at = np.flatnonzero(cut[a:b]) + a
        starts, ends = np.concatenate([[a], at + 1]), np.concatenate([at, [b]])
        first = ratio[32, data[np.minimum(starts, b - 1)]] - gain[np.minimum(starts, b - 1)]  # a stretch starts after a blank
        out += [("random", x, y) for x, y in _best(starts, ends, total[starts] - first, total[ends])]
    return out


def _best(starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    """The stretch of parts with the greatest sum above 0, LEAST_RUN characters at least, then the same beside it."""
    found, todo = [], [(0, len(starts))]
    while todo:
        i, j = todo.pop()
        # the least sum before each part; a stretch that ends there may start at any part far enough back
        least, who, best, k = np.inf, i, None, i
        for end in range(i, j):
            while k <= end and ends[end] - starts[k] >= LEAST_RUN:
                if low[k] < least:
                    least, who = low[k], k
                k += 1
            if high[end] - least > (best[0] if best else 0):
                best = (high[end] - least, who, end)
        if best:
            _, who, end = best
            found.append((int(starts[who]), int(ends[end])))
            todo += [(i, who), (end + 1, j)]
    return sorted(found)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE_TEXTS, n_bytes: int = SAMPLE_BYTES) -> np.ndarray:
    """The ratio table from the ``bound`` texts that come first by a hash of their id and text, whole.

    Nulls are left out, copies of a row count once, and a text that would take the sample over ``n_bytes`` is passed over.
    """
    text = docs[text_col].cast("string")
    rows = docs.where(docs[text_col].isNotNull()).select(F.xxhash64(docs[id_col].cast("string"), text, F.lit(4)).alias("mark"), text.alias("text"))
    first = rows.select("mark", F.octet_length("text").alias("size")).orderBy("mark").limit(bound).collect()
    chosen, room = [], n_bytes
    for mark, size in sorted({(r["mark"], r["size"]) for r in first}):
        if size <= room:
            chosen.append(mark)
            room -= size
    if not chosen:
        return ratios(*labelled([]))
    texts = rows.where(F.col("mark").isin(chosen)).groupBy("mark").agg(F.first("text").alias("text")).orderBy("mark")
    return ratios(*labelled([r["text"].encode() for r in texts.collect()]))


def find_secrets(docs: DataFrame, ratio: np.ndarray, keep: list[str] | None = None, text_col: str = "text", out_col: str = "found") -> DataFrame:
    """The ``keep`` columns of docs (default: all) and ``out_col``: spans (kind, start, end) in code points, by start.

    Base kinds stand as their patterns find them, leftmost and non-overlapping per kind; the models add ``random`` spans
    that touch no base span. Null and empty texts have none. Only the text is looked at, whole.
    """

    def find(block: Block) -> Found:
        base = base_spans(block)
        return base + apart(random_runs(block, ratio), base)

    return scan(docs, find, docs.columns if keep is None else keep, text_col, out_col)


def apart(new: Found, base: Found) -> Found:
    """The new spans that no base span touches."""
    edges = sorted((a, b) for _, a, b in base)
    if not edges:
        return new
    first = np.array([a for a, _ in edges])
    reach = np.maximum.accumulate([b for _, b in edges])
    return [x for x in new if not (k := int(np.searchsorted(first, x[2]))) or reach[k - 1] <= x[1]]


def redacted(texts: list[bytes], ratio: np.ndarray, mark: bytes) -> list[bytes]:
    """The texts with each stretch that spans cover replaced by ``mark``."""
    block = Block(texts)
    base = base_spans(block)
    spans = sorted((a, b) for _, a, b in base + apart(random_runs(block, ratio), base))
    out, parts, last = list(texts), {}, (-1, 0)
    for (a, b), row in zip(spans, block.rows([a for a, _ in spans]).tolist(), strict=True):
        if row == last[0] and a < last[1]:
            parts[row][-1] = (parts[row][-1][0], max(parts[row][-1][1], b))
        else:
            parts.setdefault(row, []).append((a, b))
        last = (row, parts[row][-1][1])
    for row, cuts in parts.items():
        at, end = int(block.starts[row]), int(block.starts[row]) + len(texts[row])
        pieces = [block.data[x:y] for x, y in zip([at, *(b for _, b in cuts)], [*(a for a, _ in cuts), end], strict=True)]
        out[row] = mark.join(pieces)
    return out


def redact(docs: DataFrame, ratio: np.ndarray, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with each stretch of its texts that spans cover replaced by ``mark``; all rows and other columns stay."""
    where, schema = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text_col):
            column = part.column(where)
            texts = column.cast(pa.binary()).to_pylist()
            new = pa.array([None if t is None else x for t, x in zip(texts, redacted([t or b"" for t in texts], ratio, mark.encode()), strict=True)], pa.binary())
            columns = [*part.columns[:where], new.cast(column.type), *part.columns[where + 1 :]]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.transform(bounded).mapInArrow(run, schema)
