"""BPE encoding and decoding of whole texts, exact, by tree concatenation.

White space separates words for good (no piece of the tokenizer reaches over
it), so a word is encoded once for each worker and then looked up. Texts of
Latin letters and common signs are split into the tokenizer's own words first,
which repeat far more often than words with their case and punctuation; the
library is asked for new ones by the thousand. A text of
more than ``long_text`` characters is cut into pieces anywhere; the pieces are
encoded by different tasks and joined pairwise. A piece is (open run at its
head, ids between, open run at its tail), and two pieces join by joining the
runs that meet. Runs of over ``unsplit`` characters without white space are
halved and joined the same way within a task.

To join two runs, a window around the border is encoded anew and grown until
its first token is one of the left run's (same place, same id) and a token
before its end is one of the right run's. A token sequence is the encoding of
a word exactly if each pair of neighbours is; pairs left of the window come
from the left run's encoding, pairs within from the window's, pairs right of
it from the right run's, so the joined sequence is exact. An id also tells
whether its token ends a word, so both sides agree on word borders.

A task makes its codec when it begins and drops it, with the words it learned,
when it ends; both generations of learned words are bounded. Long texts are
numbered and written out before they are cut, so that a number stays that of
its text whatever is computed again.

Defined results: null encodes as the empty text (no ids, empty decoded text);
repeated rows and repeated ids each keep their row; an empty table gives an
empty table; other columns, whatever their names, are carried along. Texts may
be of any length; ids of one text are one row.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.batches import ddl, mapped, place, plainly, release
from sheaf.llm.scratch import stash
from sheaf.llm.words import text_column
from sheaf.runtime import ship

#: Characters from which a text is cut into pieces, characters of a run that is halved, and words a worker remembers.
LONG_TEXT, UNSPLIT, REMEMBER = 1 << 16, 1 << 12, 100_000
#: Bytes of text that leave a task at once.
OUT_BYTES = 1 << 20

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Texts that no normalisation but lower case changes, and in which these classes are the tokenizer's.
_LATIN = re.compile(r"[\x00-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]*")
_LATIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[0-9²³¹¼½¾]|(?:[^ \t-\r\x85\xa0\w]|_)+")
#: The one pattern that _LATIN_WORD stands for, and the word end of the vocabulary.
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_END = "</w>"
_SPACE = re.compile(r"[\x20\x09-\x0D]")


def _byte_signs() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


_BYTE_SIGN = _byte_signs()


@dataclass
class Tokens:
    """A run of text without white space and its tokens with their places in it."""

    text: str
    ids: list[int]
    start: list[int]
    end: list[int]


@dataclass
class Piece:
    """Part of a text. Without white space: head only, tail None."""

    head: Tokens
    between: list[np.ndarray]
    tail: Tokens | None


class Codec:
    def __init__(self, spec: str, unsplit: int = UNSPLIT) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        read = json.loads(spec)
        self.special = [x["content"] for x in read.get("added_tokens", [])]
        self.plain = read.get("decoder") is None
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.token = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.unsplit = unsplit
        self.known: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        self.latin = self._is_latin_by_pattern(read)
        if self.latin:
            self.model_only = Tokenizer(self.tokenizer.model)
            self.model_only.pre_tokenizer = WhitespaceSplit()
            self.ends_word = np.array([t.endswith(_END) for t in self.token])
            self.as_bytes = {c: "".join(_BYTE_SIGN[b] for b in chr(c).encode()) for c in (*range(0x250), *range(0x2010, 0x20C0)) if c != 0x20}

    @staticmethod
    def _is_latin_by_pattern(read: dict) -> bool:
        """Whether the file's steps are those that the Latin split stands for."""
        steps = (read.get("normalizer") or {}).get("normalizers", []), (read.get("pre_tokenizer") or {}).get("pretokenizers", [])
        kinds = tuple([x["type"] for x in part] for part in steps)
        model = read["model"]
        return (
            kinds == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
            and steps[1][0]["pattern"].get("Regex") == _PATTERN
            and model["type"] == "BPE"
            and model.get("end_of_word_suffix") == _END
            and not model.get("dropout")
            and not model.get("ignore_merges")
        )

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """As the library's decode with skip_special_tokens=False."""
        if self.plain:
            return " ".join(map(self.token.__getitem__, ids))
        return self.tokenizer.decode(list(ids), skip_special_tokens=False)

    def _lookup(self, words: list[str], new_words) -> np.ndarray:
        """The ids of the words in order; new_words encodes those not known.

        Two generations are kept: what the older one still serves moves to the
        newer, and the older is dropped when the newer is full.
        """
        known, earlier = self.known, self.earlier
        new = []
        for w in set(words).difference(known):
            got = earlier.get(w)
            if got is None:
                new.append(w)
            else:
                known[w] = got
        if new:
            fresh = dict(zip(new, new_words(new), strict=True))
            known.update(fresh)
        out = np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32)
        if len(known) > REMEMBER:
            self.earlier, self.known = known, {}
        return out

    def _raw_words(self, words: list[str]) -> list[bytes]:
        short = [w for w in words if len(w) <= self.unsplit]
        got = dict(zip(short, self.tokenizer.encode_batch_fast(short, add_special_tokens=False), strict=True))
        return [np.array(got[w].ids if w in got else self.run(w).ids, np.int32).tobytes() for w in words]

    def _latin_words(self, words: list[str]) -> list[bytes]:
        """Words as the tokenizer's pattern cuts them, in lower case: by its model alone, many at once."""
        out: list[bytes] = []
        for i in range(0, len(words), 2000):
            part = words[i : i + 2000]
            if any(len(w) > self.unsplit for w in part):
                out += [np.array(self.run(w).ids, np.int32).tobytes() for w in part]
                continue
            joined = " ".join(part).translate(self.as_bytes)
            ids = np.array(self.model_only.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32)
            ends = ((np.flatnonzero(self.ends_word[ids]) + 1) * 4).tolist()
            packed = ids.tobytes()
            out += [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    def encode(self, text: str) -> np.ndarray:
        if self.latin and _LATIN.fullmatch(text) and not any(x in text for x in self.special):
            return self._lookup(_LATIN_WORD.findall(text.lower()), self._latin_words)
        return self._lookup([f" {w}" for w in _WORD.findall(text)], lambda new: self._raw_words([w[1:] for w in new]))

    def _tokens(self, text: str) -> Tokens:
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return Tokens(text, e.ids, [a for a, _ in e.offsets], [b for _, b in e.offsets])

    def run(self, text: str) -> Tokens:
        """A text without white space; beyond ``unsplit`` characters its halves, joined."""
        if len(text) <= self.unsplit:
            return self._tokens(text)
        half = len(text) // 2
        return self.join(self.run(text[:half]), self.run(text[half:]))

    def join(self, a: Tokens, b: Tokens) -> Tokens:
        """The encoding of a.text + b.text."""
        if not a.text or not b.text:
            return a if a.text else b
        text, cut, grow = a.text + b.text, len(a.text), 8
        if any(0 <= (p := text.find(s, max(0, cut - len(s) + 1))) < cut for s in self.special):
            return self._tokens(text)
        while True:
            left, right = len(a.ids) - grow, grow
            whole_left, whole_right = left <= 0, right >= len(b.ids)
            x = 0 if whole_left else a.start[left]
            y = len(text) if whole_right else cut + b.end[right - 1]
            if whole_left and whole_right:
                return self._tokens(text)
            grow *= 2
            if not whole_left and (text[x] == "'" or a.end[left - 1] > x or _composes(text, x)):
                continue
            w = self._tokens(text[x:y])
            n = len(w.ids)
            if not whole_left and not (n and w.ids[0] == a.ids[left] and w.start[0] == 0 and w.end[0] + x == a.end[left] and (n < 2 or w.start[1] >= w.end[0])):
                continue
            keep, rest = n, len(b.ids)
            if not whole_right:
                at = {(s + cut - x, e + cut - x, i): k for k, (s, e, i) in enumerate(zip(b.start[:right], b.end[:right], b.ids[:right], strict=True))}
                for k in range(n - 2, -1, -1):
                    t = at.get((w.start[k], w.end[k], w.ids[k]))
                    if t is not None and t + 1 < len(b.ids) and w.start[k + 1] == w.end[k] and b.start[t + 1] == b.end[t] and not _composes(text, w.end[k] + x):
                        keep, rest = k + 1, t + 1
                        break
                else:
                    continue
            left = max(left, 0)
            return Tokens(
                text,
                a.ids[:left] + w.ids[:keep] + b.ids[rest:],
                a.start[:left] + [s + x for s in w.start[:keep]] + [s + cut for s in b.start[rest:]],
                a.end[:left] + [e + x for e in w.end[:keep]] + [e + cut for e in b.end[rest:]],
            )

    def piece(self, text: str) -> Piece:
        first = _SPACE.search(text)
        if first is None:
            return Piece(self.run(text), [], None)
        head, last = first.start(), max(text.rfind(c) for c in " \t\n\r\x0b\x0c") + 1
        return Piece(self.run(text[:head]), [self.encode(text[head:last])], self.run(text[last:]))

    def join_pieces(self, a: Piece, b: Piece) -> Piece:
        if a.tail is None:
            met = self.join(a.head, b.head)
            return Piece(met, b.between, b.tail)
        met = self.join(a.tail, b.head)
        if b.tail is None:
            return Piece(a.head, a.between, met)
        return Piece(a.head, [*a.between, np.array(met.ids, np.int32), *b.between], b.tail)

    def tree(self, pieces: list[Piece]) -> np.ndarray:
        """The ids of pieces in order, joined pairwise."""
        while len(pieces) > 1:
            pairs = [pieces[i : i + 2] for i in range(0, len(pieces), 2)]
            pieces = [reduce(self.join_pieces, p) for p in pairs]
        p = pieces[0]
        return np.concatenate([np.array(p.head.ids, np.int32), *p.between, np.array(p.tail.ids if p.tail else [], np.int32)])


def _composes(text: str, i: int) -> bool:
    """Whether normalisation may join or reorder characters across the place i."""
    if i <= 0 or i >= len(text) or ord(text[i]) < 0x300:
        return False
    if unicodedata.combining(text[i]):
        return True
    nfc = unicodedata.normalize
    return nfc("NFC", text[i - 1 : i + 1]) != nfc("NFC", text[i - 1]) + nfc("NFC", text[i])


_RUN = "struct<text:string,ids:array<int>,start:array<int>,end:array<int>>"
_RUN_TYPE = pa.struct([("text", pa.string()), ("ids", pa.list_(pa.int32())), ("start", pa.list_(pa.int32())), ("end", pa.list_(pa.int32()))])


def _slices(batch: pa.RecordBatch, col: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about OUT_BYTES of text."""
    at = 0
    sizes = np.frombuffer(batch.column(col).cast(pa.string()).buffers()[1], np.int32)
    sizes = sizes[batch.column(col).offset : batch.column(col).offset + len(batch) + 1]
    while at < len(batch):
        upto = max(at + 1, int(np.searchsorted(sizes, sizes[at] + OUT_BYTES, "right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto


def _ids(rows: list[np.ndarray]) -> pa.Array:
    at = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(x) for x in rows], out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([*rows, np.zeros(0, np.int32)]), pa.int32()))


def _tokens_of(x: dict | None) -> Tokens | None:
    return None if x is None else Tokens(x["text"], x["ids"], x["start"], x["end"])


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str | None = None, long_text: int = LONG_TEXT, unsplit: int = UNSPLIT) -> DataFrame:
    """docs with a column of ids, and with decoded one of the text decoded from them.

    tokenizer: the path of a tokenizers file, read by the driver and sent to
    the tasks (its size is that of a vocabulary). A column of docs with either
    new name is replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    new = [ids, *([decoded] if decoded else [])]
    named, names = plainly(docs, new)
    t = place(names, text)
    at = named.columns.index(t)
    added = ", ids array<int>" + (", decoded string" if decoded else "")
    out_names = [*named.columns, "ids", *(["decoded"] if decoded else [])]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(spec.value, unsplit)
        for batch in batches:
            for part in _slices(batch, at):
                got = [codec.encode(x.as_py()) for x in text_column(part, t)]
                more = [pa.array([codec.decode(x.tolist()) for x in got], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*part.columns, _ids(got), *more], names=out_names)

    length = F.coalesce(F.length(t), F.lit(0))
    whole = mapped(named.where(length <= long_text), short, ddl(named.schema) + added)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(spec.value, unsplit)
        run = lambda r: None if r is None else {"text": r.text, "ids": r.ids, "start": r.start, "end": r.end}
        for batch in batches:
            for k in range(len(batch)):
                part = batch.slice(k, 1)
                p = codec.piece(part.column(2)[0].as_py())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([run(p.head)], _RUN_TYPE), _ids([np.concatenate([*p.between, np.zeros(0, np.int32)])]), pa.array([run(p.tail)], _RUN_TYPE)], names=["row", "no", "head", "between", "tail"])

    def joined(group: pa.Table) -> pa.Table:
        codec = Codec(spec.value, unsplit)
        group = group.sort_by("no")
        between = [np.asarray(x.values, np.int32) for x in group["between"]]
        heads, tails = ([_tokens_of(x) for x in group[k].to_pylist()] for k in ("head", "tail"))
        got = codec.tree([Piece(h, [b], e) for h, b, e in zip(heads, between, tails, strict=True)])
        text_of = {"decoded": pa.array([codec.decode(got.tolist())], pa.string())} if decoded else {}
        release()
        return pa.table({"row": group["row"][:1].combine_chunks(), "ids": _ids([got])} | text_of)

    long = stash(named.where(length > long_text).withColumn("long_row", F.monotonically_increasing_id()), "bpe-long")
    texts = F.transform(F.sequence(F.lit(0), F.ceil(F.length(t) / long_text).cast("int") - 1), lambda i: F.substring(F.col(t), i * long_text + 1, F.lit(long_text)))
    pieces = long.select(F.col("long_row").alias("row"), F.posexplode(texts).alias("no", "piece")).repartition("row", "no")
    encoded = mapped(pieces, cut, f"row long, no int, head {_RUN}, between array<int>, tail {_RUN}")
    whole_ids = encoded.groupBy("row").applyInArrow(joined, f"row long{added}")
    return whole.unionByName(long.join(whole_ids, long["long_row"] == whole_ids["row"]).select(*out_names)).toDF(*names, *new)


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the text decoded from a column of ids (null: null)."""
    ship(df.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())
    named, names = plainly(df, [decoded])
    at = named.columns.index(place(names, ids))
    out_names = [*named.columns, "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(spec.value, UNSPLIT)
        for batch in batches:
            texts = [None if x is None else codec.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=out_names)

    return mapped(named, run, ddl(named.schema) + ", decoded string").toDF(*names, decoded)
