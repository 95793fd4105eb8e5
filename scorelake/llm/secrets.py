"""Secret scans: three fixed kinds by pattern, further random strings by their token efficiency.

Ordinary strings of letters and digits have long pieces in a byte-pair vocabulary, random ones fall
into pieces of one or two characters.  Strings of few characters per token are reported, unless
they are known digests or identifiers.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import text_of

VOCABULARY = "byte_bpe_50k.tiktoken"
#: A candidate's least length, and the characters per token below which it counts as random.
LEAST, EFFICIENCY = 16, 2.0

# Kinds in order, their patterns, least lengths of what is measured.
KINDS = ("assign", "access", "hex", "random")
_NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name) for name in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(f"(?:{_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")  # a run of under 20 characters holds no other that is longer
HEX = re.compile("[0-9a-f]{24,}")
LEAST_VALUE = 6

_CANDIDATE = re.compile(f"[A-Za-z0-9+/_=-]{{{LEAST},}}")
_MIXED = re.compile("(?=.*[0-9])(?=.*[A-Za-z])")
_LETTERS = re.compile(f"[A-Za-z]{{{LEAST},}}")
# Lengths of hexadecimal digests, and forms of identifiers that are no secrets.
_DIGEST = re.compile("(?i:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{48}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})")
_IDENTIFIER = re.compile(
    "(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"  # UUID
    "|(?:sha|md)[0-9]+[-_=].*"  # named digest
    "|[0-9]{4}-?[0-9]{2}-?[0-9]{2}[T_-]?[0-9:]*Z?)")  # time stamp
_BASES = re.compile("[ACGTUN]+|[acgtun]+")
_ACCOUNT = re.compile("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
#: A white space, quote, comma or bracket ends an address.
_BREAK = re.compile(r"[\s\"'`,;<>(){}\[\]|\\]")
#: Name and password before the host of an address; a port is none.
_LOGIN = re.compile(r"(?:[^:@/?#]*:(?![0-9]{1,5}/)[^@?#]*|[^:@/?#]+)@")
_HOOK = re.compile(r"(?i)(?:^|[@./-])(?:web)?hooks?(?:[./-]|$)")


@cache
def _codes(file: str) -> tiktoken.Encoding:
    path = file if os.path.isabs(file) else public_tokenizers.path(file)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def efficiency(text: str, vocabulary: str = VOCABULARY) -> float:
    """Characters per token."""
    return len(text) / max(1, len(_codes(vocabulary).encode_ordinary(text)))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points: leftmost matches of each kind that do not overlap, short ones dropped."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_VALUE] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _account(word: str) -> bool:
    """Whether the word is a bank account number with right check digits."""
    return bool(_ACCOUNT.fullmatch(word)) and int("".join(str(int(c, 36)) for c in word[4:] + word[:4])) % 97 == 1


class _Addresses:
    """Finds the addresses that candidates, taken in order, are parts of; each character is looked at a few times at most."""

    def __init__(self, text: str):
        self.text, self.breaks = text, _BREAK.finditer(text)
        self.coming = next(self.breaks, None)
        self._new_run(0)

    def _new_run(self, first: int) -> None:
        self.first = self.seen = self.signed = first
        self.scheme = self.at = self.sign = -1

    def _read(self, start: int, end: int) -> None:
        while self.coming and self.coming.start() < start:
            self._new_run(self.coming.end())
            self.coming = next(self.breaks, None)
        text = self.text
        scheme = text.rfind("://", max(self.first, self.seen - 2), end)
        if scheme >= 0:
            self.scheme, place = scheme, scheme + 3
            stop = self.coming.start() if self.coming else len(text)
            login = _LOGIN.match(text, place, stop)
            marks = [i for i in (text.find("?", place, stop), text.find("#", place, stop)) if i >= 0]
            self.login, self.query = login.end() if login else place, min(marks, default=stop)
            self.hook = bool(_HOOK.search(text[place:self.query]))
        self.at = max(self.at, text.rfind("@", self.seen, end))
        self.sign = max(self.sign, *(text.rfind(c, self.signed, start) for c in "=?#"))
        self.seen, self.signed = end, start

    def judged_from(self, start: int, end: int) -> int | None:
        """Where the candidate begins to count; None if it is host or path of an address.

        Logins, what follows ``?`` or ``#``, and the paths of web hooks count.
        """
        self._read(start, end)
        if self.scheme < 0:
            return start if self.at < 0 or self.at <= self.sign < start else None
        place = self.scheme + 3
        if place < self.login and start < self.login or start > self.query or self.hook:
            return max(start, place)
        return None


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs that sorted spans cover."""
    starts, ends = [], []
    for s, e in spans:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def random_spans(text: str, known: list[tuple[int, int, int]], vocabulary: str = VOCABULARY, below: float = EFFICIENCY) -> list[tuple[int, int, int]]:
    """Further strings of few characters per token; those that touch a known span are left out."""
    found, addresses = [], _Addresses(text)
    starts, ends = _merged(sorted((s, e) for s, _, e in known))
    for m in _CANDIDATE.finditer(text):
        word = m.group()
        start, letters = m.start(), None
        if not _MIXED.match(word):
            letters = max(_LETTERS.findall(word), key=len, default=None)
            if letters is None:
                continue
        if _DIGEST.fullmatch(word) or _IDENTIFIER.fullmatch(word) or _BASES.fullmatch(word) or _account(word):
            continue
        before = bisect_left(starts, m.end()) - 1  # the last run that begins before the candidate ends
        if before >= 0 and ends[before] > start:
            continue
        # strings without a digit are judged by their longest run of letters: signs between short words are no secret
        if efficiency(letters or word, vocabulary) < below and not _named(word) and (start := addresses.judged_from(start, m.end())) is not None:
            if m.end() - start >= LEAST and efficiency(letters or text[start:m.end()], vocabulary) < below:
                found.append((start, 3, m.end()))
    return found


def _named(word: str) -> bool:
    """Whether short words and numbers make up the whole: a file name or a title with a date."""
    parts = re.split("[-_/]", word)
    return len(parts) >= 4 and all(re.fullmatch("[a-z]{1,12}|[A-Z][a-z]{1,11}|[A-Z]{1,5}|v?[0-9]{1,4}", p) for p in parts)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secrets(docs: DataFrame, vocabulary: str = VOCABULARY, below: float = EFFICIENCY) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Whole texts are searched; positions are code points, ends exclusive.  base_sha256 is of
    kind:start:end of the three fixed kinds, by start and then kind, comma-joined (of the empty
    string where there is none); spans joins all kinds likewise.  A null text counts as empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                more = random_spans(text, base, vocabulary, below)
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + more)), len(more)))
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_random bigint")
