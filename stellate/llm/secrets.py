"""Secret scans: fixed forms, and novel strings by dictionary-primed zstandard.

Three fixed forms are found by patterns: assignments to names such as password or token,
access keys, and long hexadecimal strings. Beside them, every long string with digits
and letters that stands near a sensitive word is a candidate. Its novelty is the number
of compressed bytes it adds to the text around it, under a zstandard dictionary of code
and identifiers, for each of its characters: names made of known words compress well,
random strings do not. The dictionary holds a short list of common code and the frequent
words of the corpus itself, counted over all rows, of which those that stand under one id alone and
strings of 16 characters with two digits, which may be secrets, are left out. Copies of a
candidate in the text around it are taken out before measuring. Candidates of at least
`novelty` are reported as novel. Spans of the fixed forms get a novelty too, and stay
whatever it is. What is no candidate by design: strings under 16 characters, without digits
or without letters, and those that start more than REACH characters after the word.

Defined cases: a null text counts as empty and has no spans; repeated rows are scanned
each on its own; texts are read whole; starts and ends are code points. Matches of one
form do not overlap each other; novel spans overlap no others.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_rows

# The forms, in their order, and the least size of what they match.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(rf"[0-9a-f]{{{HEX_LEAST},}}")
#: One of these is in every match of ASSIGN, in lower case.
ASSIGN_WORDS = ("passw", "secret", "token", "api")

#: A novel string: at least so many characters, near a sensitive word before it.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(r"passw|secret|token|api.?key|access.?key|credential|private.?key|bearer|auth|signature", re.I | re.A)
SENSITIVE_WORDS = ("passw", "secret", "token", "key", "credential", "bearer", "auth", "signature")
#: Characters after a sensitive word within which a candidate may start, and characters of context on either side.
REACH, CONTEXT = 48, 256
NOVELTY = 0.7

#: The dictionary: identifiers and code that are no secrets though they stand near sensitive words.
DICTIONARY = (
    "import os, sys, json, re, time, logging from typing import Optional def __init__(self, config): self.config = config return None "
    "access_token refresh_token id_token csrf_token auth_token token_type token_expiry token_count max_tokens num_tokens tokenizer_config "
    "secret_key client_secret client_id secret_name secretKeyRef valueFrom password_hash password_reset password_confirmation user_password "
    "api_key api_key_header x-api-key apiKeyRequired private_key public_key key_id key_name primary_key foreign_key unique_key "
    "authorization authentication authenticated basic_auth oauth2 bearer credentials default_credentials service_account signature "
    "example_example placeholder changeme your_token_here your-api-key-here xxxxxxxxxxxxxxxx 0123456789abcdef 1234567890 abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000-0000-0000-0000-000000000000 localhost:8080 127.0.0.1 process.env.API_KEY os.environ.get('SECRET') "
    "https://www.example.com/index.html?page=1&id=2 version 2020-01-01T00:00:00Z sha256 md5 base64 utf-8 application/json content-type "
).encode()


#: Words and bytes of the corpus's part of the dictionary at most.
DICTIONARY_WORDS, DICTIONARY_BYTES = 8192, 48 << 10


def learn_dictionary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """The words that stand in most rows of `docs`, the most frequent last, and the fixed list after them. All rows
    are read; words that stand under one id alone are left out, however often its row is repeated."""
    words = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z][A-Za-z0-9_.-]{4,39}"), F.lit(0)))).alias("word")
    # Tasks count before they shuffle, so what moves is words of a task, not of a text.
    counts = text_rows(docs, id_col, text_col).select("doc_id", words).groupBy("word").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("z"))
    secret = (F.length("word") >= 16) & F.col("word").rlike("[0-9].*[0-9]")
    # Each task sends its best words to the driver, so they are few.
    found = counts.where((F.col("a") < F.col("z")) & ~secret).select("word", "n").repartition(8).orderBy(F.desc("n"), "word").limit(DICTIONARY_WORDS).collect()
    kept, size = [], 0
    for row in found:
        size += len(row["word"]) + 1
        if size > DICTIONARY_BYTES:
            break
        kept.append(row["word"])
    return " ".join(kept[::-1]).encode() + b" " + DICTIONARY


class Scanner:
    def __init__(self, novelty: float = NOVELTY, dictionary: bytes = DICTIONARY):
        self.least = novelty
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=9)
        self.size = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_dict_id=False).compress

    def novelty(self, text: str, start: int, end: int) -> float:
        """Compressed bytes that text[start:end] adds to its surroundings, for each of its bytes."""
        own = text[start:end]
        around = (text[max(0, start - CONTEXT) : start].replace(own, " ") + text[end : end + CONTEXT].replace(own, " ")).encode("utf-8", "replace")
        own = own.encode("utf-8", "replace")
        return (len(self.size(around + own)) - len(self.size(around))) / len(own)

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        """(kind, start, end, novelty) by start, then by kind as listed."""
        spans, low = [], text.lower()
        if any(w in low for w in ASSIGN_WORDS):
            spans += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        if "AKIA" in text:
            spans += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
        spans += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
        out = [(kind, start, end, self.novelty(text, value, end)) for kind, start, end, value in spans]
        if any(w in low for w in SENSITIVE_WORDS):
            out += self._novel(text, sorted((start, end) for _, start, end, _ in spans))
        return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))

    def _novel(self, text: str, taken: list[tuple[int, int]]):
        """Candidates that start near a sensitive word before them, overlap no other span and are novel."""
        words, word = list(SENSITIVE.finditer(text)), 0
        reach, at, ends = -1, 0, 0
        for m in CANDIDATE.finditer(text) if words else ():
            start, end = m.span()
            while word < len(words) and words[word].start() <= start:
                reach = max(reach, words[word].end() + REACH)
                word += 1
            while at < len(taken) and taken[at][0] < end:
                ends = max(ends, taken[at][1])
                at += 1
            if start > reach or ends > start:
                continue
            s = m[0]
            if any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and (found := self.novelty(text, start, end)) >= self.least:
                yield "novel", start, end, found


def scan(docs: DataFrame, novelty: float = NOVELTY, dictionary: bytes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end, novelty) of whole texts; one row per row of `docs`, no shuffle of texts."""
    dictionary = learn_dictionary(docs, id_col=id_col, text_col=text_col) if dictionary is None else dictionary
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))

    def run(batches):
        scanner = Scanner(novelty, dictionary)
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "novelty"), s)) for s in scanner.scan(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return map_batches(text_rows(docs, id_col, text_col), run, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,novelty:double>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts by form, a digest of the fixed forms' spans, and all spans as text."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]]
    base = F.sha2(said(F.filter("spans", lambda s: s["kind"] != "novel")), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), said(F.col("spans")).alias("spans"))


def redact(
    docs: DataFrame, novelty: float = NOVELTY, dictionary: bytes | None = None, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", count_col: str = "n_chars"
) -> DataFrame:
    """`docs` with `mark` in place of every secret; all else stays, but that `count_col`, if there
    is one, is set to the new number of code points of changed texts."""
    dictionary = learn_dictionary(docs, id_col=id_col, text_col=text_col) if dictionary is None else dictionary
    names = docs.columns
    at = names.index(text_col)

    def clean(scanner, text):
        out, done = [], 0
        for _, start, end, _ in scanner.scan(text):
            if end <= done:
                continue
            if start >= done:
                out += [text[done:start], mark]
            done = end
        return "".join(out) + text[done:] if done else text

    def run(batches):
        scanner = Scanner(novelty, dictionary)
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [t if t is None else clean(scanner, t) for t in old]
            cols = list(batch.columns)
            cols[at] = pa.array(new, cols[at].type)
            if count_col in names:
                k = names.index(count_col)
                cols[k] = pa.array([n if a == b else len(b) for n, a, b in zip(cols[k].to_pylist(), old, new)], cols[k].type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return map_batches(docs, run, docs.schema)
