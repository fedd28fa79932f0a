"""Operator 1: byte-level BPE encoding and decoding by monoid tree reduction.

A text is halved (at a power of two of leaves) until its parts are short; the parts are encoded apart. Two neighbours are joined by re-encoding a
window of text around their seam; each end of the window grows until it lies where no token outside can change. Joining
is associative: the tokens of a text don't depend on how it was halved. An end of the window is stable

- at a *certain boundary*: between two characters that the splitting pattern can never put in one match, whatever stands
  before or after them, and where neither side's matches look past it; or
- inside a run of ASCII characters of one class that goes on for EDGE characters on both sides, so that the same match
  covers them in the part, in the window and in the whole text, at a boundary of the part's tokens whose two
  neighbours, one of the part and one of the window, stay as they are when their bytes are encoded together. Merging is
  local: the first merge of the whole that crosses a boundary between two tokens would also be made in those two
  alone, so that a chain of tokens is the encoding of its bytes if each neighbouring pair is that of its own.

The first kind ends windows in ordinary text, the second in endless words and runs of spaces, so that no run is ever
encoded as one. For public_tokenizers.PATTERN (runs of letters, of numbers, of other characters, each with at most one
space before it; runs of white space, of which the last character goes with what follows; English contractions after an
apostrophe) certain boundaries are the changes

- from a character that isn't white space to one that is: white space only ever starts a match or stays alone;
- from a letter to a classified character that isn't a letter, and between ASCII numbers and classified others;
- from a classified other but the apostrophe to a letter (an apostrophe may begin a contraction).

Classified are ASCII, white space, and blocks of letters and of full-width marks that are old in every Unicode version.
Where a side has neither kind near (a run of unclassified characters), the window grows to the end of the part, at worst to
both parts: correct, and at most log2(length / leaf) times the work.

Edge cases: a null text counts as empty and has no ids; bytes that aren't UTF-8 count as U+FFFD; repeated rows give
repeated results; a clashing column of the input is replaced by the result's; an empty table gives an empty one; a text of
one character repeated ten million times takes its length times the logarithm of the number of leaves at worst.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Characters of a leaf. Short leaves mean more seams, long ones only more memory at once.
LEAF = 512
#: Characters searched on either side of a seam at first; doubled until an end is found.
WINDOW = 32
#: Characters that a run must go on for on both sides of a window's end: longer than any contraction.
EDGE = 8

_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_NUMBER = "0-9"
_LETTER = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u01ba\\u0391-\\u03a1\\u03b1-\\u03c9\\u0410-\\u044f\\u3041-\\u3094\\u30a1-\\u30fa\\u4e00-\\u9fa5\\uac00-\\ud7a3"
_MARKS = "!-&(-/:-@\\[-`{-~\\u3001-\\u3003\\u3008-\\u3011\\uff01-\\uff0f\\uff1a-\\uff20"
_OTHER = f"'{_MARKS}"
_BOUNDARY = re.compile(
    f"(?<=[^{_SPACE}])(?=[{_SPACE}])|(?<=[{_LETTER}])(?=[{_NUMBER}{_OTHER}])|(?<=[{_NUMBER}])(?=[{_LETTER}{_OTHER}])"
    f"|(?<=[{_OTHER}])(?=[{_NUMBER}])|(?<=[{_MARKS}])(?=[{_LETTER}])"
)
#: Runs within which a window may end, all ASCII, so that bytes are characters.
_RUN = re.compile("[A-Za-z]+|[0-9]+|[!-&(-/:-@\\[-`{-~]+|[\\t-\\r ]+")
#: White space that is cut without the splitting pattern.
LONG_SPACE = 10_000
_LONG_SPACE = re.compile(f"[{_SPACE}]{{{LONG_SPACE},}}")


class ByteBPE:
    """A tiktoken vocabulary with tree-shaped encoding and decoding."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF, window: int = WINDOW):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = tiktoken.Encoding("riftspark", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = {i: t for t, i in ranks.items()}
        self.length = {i: len(t) for t, i in ranks.items()}
        self.leaf, self.window = max(2, leaf), max(2, window)
        self.pairs: dict[tuple[int, int], bool] = {}

    def encode(self, text: str) -> list[int]:
        return self._tree(text, 0, len(text)) if text else []

    def _tree(self, text: str, a: int, b: int) -> list[int]:
        if b - a <= self.leaf:
            return self.tokens.encode_ordinary(text[a:b])
        # parts of leaf x 2^k characters, so that seams in a run of repeated tokens often fall between two of them
        m = a + (self.leaf << ((b - a - 1) // self.leaf).bit_length() - 1)
        return self.join(text, a, m, b, self._tree(text, a, m), self._tree(text, m, b))

    def join(self, text: str, a: int, m: int, b: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of text[a:b] from those of text[a:m] and text[m:b]."""
        before, after = self._before(text, a, m, left), self._after(text, m, b, right)
        lo, i, check_left = next(before)
        hi, j, check_right = next(after)
        while True:
            middle = self._window(text[lo:hi])
            if check_left and not self.stays(left[i - 1], middle[0]):
                lo, i, check_left = next(before)
            elif check_right and not self.stays(middle[-1], right[j]):
                hi, j, check_right = next(after)
            else:
                break
        del left[i:]
        left += middle
        left += right[j:] if j else right
        return left

    def _window(self, text: str) -> list[int]:
        """The ids of a window. Of a long run of white space the splitting pattern matches all, or all but the last
        character where another follows; such runs are cut here, as the pattern's matcher would exhaust its stack."""
        out, at = [], 0
        for run in _LONG_SPACE.finditer(text) if len(text) > LONG_SPACE else ():
            end = run.end() - (run.end() < len(text))
            out += self.tokens.encode_ordinary(text[at : run.start()])
            out += self.tokens._core_bpe.encode_single_piece(text[run.start() : end].encode())
            at = end
        return out + self.tokens.encode_ordinary(text[at:])

    def stays(self, first: int, second: int) -> bool:
        """Whether two tokens are the encoding of their bytes."""
        pair = (first, second)
        if pair not in self.pairs:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            self.pairs[pair] = self.tokens._core_bpe.encode_single_piece(self.bytes[first] + self.bytes[second]) == [first, second]
        return self.pairs[pair]

    def _before(self, text: str, a: int, m: int, left: list[int]) -> Iterator[tuple[int, int, bool]]:
        """Ends of the window before m, nearest first: the place, how many tokens of left lie before it, and whether it is
        inside a run, where the tokens on both sides must stay. The last is a."""
        w, at, i = self.window, m, len(left)
        while True:
            lo = max(a, m - w)
            # the classes of both neighbours must lie in the part; what ends at m itself was cut there
            found = [x.start() for x in _BOUNDARY.finditer(text, lo, m) if a < x.start() < m]
            if found:
                rest, i = len(text[found[-1] : m].encode()), len(left)
                while rest > 0:
                    i -= 1
                    rest -= self.length[left[i]]
                if rest:
                    raise AssertionError("a token spans a certain boundary")
                yield found[-1], i, False
                # a certain boundary always holds
                return
            if lo == a:
                break
            if w > 3 * EDGE and (run := _RUN.match(text, lo, m)) and run.end() == m:
                while i > 1 and at - self.length[left[i - 1]] >= lo + EDGE:
                    i -= 1
                    at -= self.length[left[i]]
                if at <= m - EDGE:
                    yield at, i, True
            w *= 2
        yield a, 0, False

    def _after(self, text: str, m: int, b: int, right: list[int]) -> Iterator[tuple[int, int, bool]]:
        """The same after m; the number is that of the tokens of right before the place. The last is b."""
        w, at, j = self.window, m, 0
        while True:
            hi = min(b, m + w)
            x = next((x.start() for x in _BOUNDARY.finditer(text, m, hi) if m < x.start() < b), None)
            if x is not None:
                more, j = len(text[m:x].encode()), 0
                while more > 0:
                    more -= self.length[right[j]]
                    j += 1
                if more:
                    raise AssertionError("a token spans a certain boundary")
                yield x, j, False
                return
            if hi == b:
                break
            if w > 3 * EDGE and (run := _RUN.match(text, m, hi)) and run.end() == hi:
                while j < len(right) - 1 and at + self.length[right[j]] <= hi - EDGE:
                    at += self.length[right[j]]
                    j += 1
                if at >= m + EDGE:
                    yield at, j, True
            w *= 2
        yield b, len(right), False

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids; parts are concatenated up the tree."""
        if len(ids) <= self.leaf:
            return self.tokens.decode_bytes(ids)
        m = len(ids) // 2
        return self.decode(ids[:m]) + self.decode(ids[m:])


@functools.lru_cache(maxsize=4)
def codec(vocabulary: str, leaf: int = LEAF) -> ByteBPE:
    """vocabulary: the name of a rank file that public_tokenizers.path() finds on each executor, or a path."""
    import public_tokenizers

    return ByteBPE(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary), public_tokenizers.PATTERN, leaf)


def ids_digest(ids: list[int]) -> str:
    """SHA-256 of the decimal ids joined by commas, in parts: the joined text may be long."""
    h = hashlib.sha256()
    for k in range(0, len(ids), 65_536):
        h.update((("," if k else "") + ",".join(map(str, ids[k : k + 65_536]))).encode())
    return h.hexdigest()


def encode(df: DataFrame, text: str = "text", vocabulary: str = "byte_bpe_multi_50k.tiktoken", ids: str | None = "ids", digests: bool = False, without_text: bool = False) -> DataFrame:
    """Add to each row the token ids of its text, or digests of them and of what they decode to, or both.

    Narrow: no shuffle; a task holds one Arrow batch and one text's tokens. Rows are independent, so that a lost
    executor costs its own tasks only.
    """
    added = [T.StructField("n_tokens", T.LongType())]
    if ids:
        added.append(T.StructField(ids, T.ArrayType(T.IntegerType())))
    if digests:
        added += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    common.bounded_batches(df.sparkSession)
    names = {f.name.lower() for f in added}
    own = [c for c in df.columns if c.lower() not in names and c != text]
    # the text is sent once, last
    rest = df.select(*[df[f"`{c}`"] for c in own], df[f"`{text}`"])
    kept = len(own) + (not without_text)
    schema = T.StructType([*rest.schema.fields[:kept], *added])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for batch in batches:
            n, all_ids, sha, back = [], [], [], []
            for raw in common.as_bytes(batch.column(batch.num_columns - 1)):
                got = bpe.encode(common.as_text(raw))
                n.append(len(got))
                if ids:
                    all_ids.append(pa.array(got, pa.int32()))
                if digests:
                    sha.append(ids_digest(got))
                    back.append(hashlib.sha256(bpe.decode(got)).hexdigest())
            columns = [*batch.columns[:kept], pa.array(n, pa.int64())]
            if ids:
                flat = pa.concat_arrays(all_ids) if all_ids else pa.array([], pa.int32())
                columns.append(pa.ListArray.from_arrays(pa.array([0, *_running(n)], pa.int32()), flat))
            if digests:
                columns += [pa.array(sha, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    out = rest.mapInArrow(run, schema)
    return out.select(*[f"`{c}`" for c in df.columns if c in out.columns and c.lower() not in names], *[f.name for f in added])


def _running(n: list[int]) -> Iterator[int]:
    total = 0
    for x in n:
        total += x
        yield total


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """Add to each row the bytes of its token ids (null ids: none), as binary."""
    rest = df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() != text.lower()], df[f"`{ids}`"].alias("__ids"))
    schema = T.StructType([*rest.schema.fields[:-1], T.StructField(text, T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for batch in batches:
            out = [bpe.decode(x.as_py() or []) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], [f.name for f in schema.fields])

    return rest.mapInArrow(run, schema)


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents: its number of tokens and digests of the ids and of what they decode to."""
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, ids=None, digests=True, without_text=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
