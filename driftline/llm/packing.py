"""Packing of tokenised documents into sequences of fixed length (sum-of-squares rule).

Documents are tokenised where they lie. Only their lengths travel on: pieces are dealt into groups of
bounded size by a hash, so copies and hot sources spread evenly, and each group is packed on its own.

Sum-of-squares rule: an item goes where the sum, over all residual gaps, of the squared number of open
sequences with that gap becomes smallest, a new sequence included. Pieces come longest first. The rule
needs only the count of open sequences per gap.

Defined cases: null text is empty; an empty document is the end id alone; a document longer than the
capacity is cut into pieces of exactly the capacity and a rest; repeated rows are packed each for itself;
a null id is kept; no rows give no rows. Columns other than id and text are ignored.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import text_slices
from driftline.session import materialise

CAPACITY = 2048
GROUP_ROWS = 50_000
CACHED_CHUNKS = 800_000
LONG_WORD = 64  # bytes; longer runs of letters need too many rounds

# The visible characters that stand for bytes in byte-level vocabularies.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: b for b in _VISIBLE} | {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in set(_VISIBLE))}


class WordPairs:
    """Ids of many words at once by the merges of a word-level byte-pair model.

    In every round each word contracts all places of its pair of least rank, from the left. That is what one contraction after the
    other gives, because no merge makes a token that an earlier merge needs (checked when the model is read).
    """

    def __init__(self, model: dict):
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made_at = {left + right: rank for rank, (left, right) in enumerate(merges)}
        if any(made_at.get(part, -1) > rank for rank, pair in enumerate(merges) for part in pair) or len(made_at) < len(merges):
            raise ValueError("merges are not in the order in which their tokens are made")
        characters = [chr(BYTE_CHARS[b]) for b in range(256)]
        self.inner = np.array([vocabulary.get(c, -1) for c in characters], np.int64)
        self.last = np.array([vocabulary.get(c + suffix, -1) for c in characters], np.int64)
        self.shift, self.kind = (16, np.uint32) if max(vocabulary.values()) < 1 << 16 else (32, np.int64)
        keys = np.array([vocabulary[left] << self.shift | vocabulary[right] for left, right in merges], self.kind)
        self.rank = np.argsort(keys)
        self.keys = keys[self.rank]
        self.made = np.array([vocabulary[left + right] for left, right in merges], np.int64)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each word has. Words must not be empty."""
        lengths = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        token, ends = self.inner[raw], np.cumsum(lengths) - 1
        token[ends] = self.last[raw[ends]]
        word = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = len(self.keys)
        while len(token):
            key = (token[:-1] << self.shift | token[1:]).astype(self.kind)
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.full(len(token), none)
            known = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank[:-1][known] = self.rank[at[known]]
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(first, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, first), size)
            still = least < none
            done.append((word[~still], token[~still]))
            token, word, rank, least = token[still], word[still], rank[still], least[still]
            place = np.flatnonzero(rank == least)
            run = np.flatnonzero(np.concatenate([[True], np.diff(place) > 1]))[: len(place)]
            place = place[(place - np.repeat(place[run], np.diff(np.append(run, len(place))))) % 2 == 0]
            token[place] = self.made[rank[place]]
            stays = np.ones(len(token), bool)
            stays[place + 1] = False
            token, word = token[stays], word[stays]
        word, token = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64),) * 2
        return token[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))


class ChunkEncoder:
    """Ids of white-space separated chunks, each chunk encoded once while it is cached.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its chunks
    in turn. Chunks that are one run of letters, perhaps with a closing mark, are lower-cased here and encoded many at a time; all
    others, and very long ones, go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.pairs = WordPairs(json.load(file)["model"])
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {b"": -1}  # chunks; each is a word and a mark (-1: none). Nothing is no chunk.
        self.word_of, self.mark_of = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.words: dict[bytes, int] = {}
        self.flat, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _parts(self, chunk: bytes) -> tuple[bytes, int] | None:
        """A chunk as a lower-case run of letters and a closing mark, if it is one."""
        mark = -1
        if chunk[-1] in b".,":
            chunk, mark = chunk[:-1], int(self.pairs.last[chunk[-1]])
        if chunk.isalpha():  # ASCII letters
            return chunk.lower(), mark
        if not chunk or chunk.isascii() or len(chunk) > LONG_WORD:
            return None
        text = chunk.decode()
        if max(text) < "ɐ":
            word = unicodedata.normalize("NFC", text).lower()
            if word.isalpha():  # still one run of letters
                return word.encode(), mark
        return None

    def learn(self, chunks: list[bytes]) -> None:
        """Make the ids of these distinct chunks known."""
        fresh = [c for c in chunks if c not in self.index]
        if not fresh:
            return
        if len(self.index) + len(fresh) > CACHED_CHUNKS:
            self.clear()
            fresh = [c for c in chunks if c]
        words, marks, bulk, other = [], [], [], []
        known = len(self.words)
        for chunk in fresh:
            parts = self._parts(chunk)
            if parts is None or len(parts[0]) > LONG_WORD:
                parts = b"\0" + chunk, -1  # as a whole; no run of letters starts like that
            word, mark = parts
            if word not in self.words:
                self.words[word] = len(self.words)
                (other if word[0] == 0 else bulk).append(word)
            words.append(self.words[word])
            marks.append(mark)
        places = np.array([self.words[w] for w in (*bulk, *other)], np.int64) - known
        ids, counts = self.pairs.encode(bulk) if bulk else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        whole = [x.ids for x in self.tokenizer.encode_batch_fast([w[1:].decode() for w in other], add_special_tokens=False)]
        ids = np.concatenate([ids, np.fromiter((i for x in whole for i in x), np.int64)])
        counts = np.concatenate([counts, np.array([len(x) for x in whole], np.int64)])
        # Bring the new words into the order of their numbers.
        order = np.argsort(places)
        begin = (np.cumsum(counts) - counts)[order]
        sizes = counts[order]
        ends = np.cumsum(sizes)
        ids = ids[np.repeat(begin - (ends - sizes), sizes) + np.arange(len(ids))]
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + ends])
        self.index.update(zip(fresh, range(len(self.word_of), len(self.word_of) + len(fresh))))
        self.word_of = np.concatenate([self.word_of, words])
        self.mark_of = np.concatenate([self.mark_of, marks])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (strings, null for empty) in a row, and where each text ends."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        chunks = split.flatten().cast(pa.binary()).dictionary_encode()
        distinct = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(distinct)
        number = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))
        at = number[chunks.indices.to_numpy()] if len(distinct) else np.zeros(0, np.int64)
        counts = np.concatenate([[0], np.cumsum(at >= 0)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        at = at[at >= 0]
        word, mark = self.word_of[at], self.mark_of[at]
        starts = self.starts[word]
        sizes = self.starts[word + 1] - starts
        ends = np.cumsum(sizes + (mark >= 0))
        total = int(ends[-1]) if len(ends) else 0
        marked = mark >= 0
        ids = np.empty(total, np.uint32)
        inside = np.ones(total, bool)
        inside[ends[marked] - 1] = False
        ids[~inside] = mark[marked]
        before = np.cumsum(sizes) - sizes
        ids[inside] = self.flat[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]
        return ids, np.concatenate([[0], ends])[counts[1:]]


_encoders: dict[str, ChunkEncoder] = {}


def pieces_of(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 0,
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, if asked for, the ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _encoders:
            _encoders[tokenizer_path] = ChunkEncoder(tokenizer_path)
        encoder = _encoders[tokenizer_path]
        for batch in text_slices(batches, text_col):
            ids, ends = encoder.encode(batch.column(batch.schema.get_field_index(text_col)))
            ids, begin = ids.astype("<u4"), 0
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for k, end in enumerate(ends.tolist()):
                own = np.append(ids[begin:end], np.uint32(end_id)).astype("<u4")
                begin = end
                for n, first in enumerate(range(0, len(own), capacity)):
                    part = own[first : first + capacity]
                    row.append(k)
                    piece.append(n)
                    start.append(first)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if keep_ids:
                        kept.append(part.astype(np.int32))
            columns = {
                id_col: batch.column(batch.schema.get_field_index(id_col)).take(pa.array(row, pa.int64())),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
            }
            if keep_ids:
                columns["ids"] = pa.array(kept, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return docs.select(id_col, text_col).mapInArrow(run, schema + (", ids array<int>" if keep_ids else ""))


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each item, taken in the order given."""
    open_bins = np.zeros(capacity + 1, np.int64)
    members: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    made = 0
    for i, size in enumerate(lengths.tolist()):
        here = open_bins[size:]
        # Half the change of the sum when an open sequence of each gap takes the item; a full one has no gap.
        change = np.where(here > 0, open_bins[: capacity + 1 - size] - here + 1.0, np.inf)
        if here[0]:
            change[0] = 0.5 - here[0]
        best = int(change.argmin())
        fresh = 0.0 if size == capacity else open_bins[capacity - size] + 0.5
        if change[best] <= fresh and change[best] < np.inf:
            gap = size + best
            target = members[gap].pop()
            open_bins[gap] -= 1
        else:
            gap, target = capacity, made
            made += 1
        bins[i], offsets[i] = target, capacity - gap
        if gap > size:
            open_bins[gap - size] += 1
            members[gap - size].append(target)
    return bins, offsets


def pack_pieces(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Add `sequence_id` and `offset` to stored pieces. Groups of about `group_rows` pieces are packed apart."""
    groups = max(1, -(-pieces.count() // group_rows))
    # The place in the stored table parts rows that are alike in all else.
    place = F.xxhash64(F.lit("pack"), F.monotonically_increasing_id())
    rows = pieces.withColumn("_group", F.pmod(place, F.lit(groups)))

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), (id_col, "ascending"), ("piece", "ascending")])
        bins, offsets = sum_of_squares(group["length"].to_numpy(), capacity)
        ids = group["_group"].to_numpy()[0] + groups * bins
        return group.drop_columns("_group").append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return rows.groupBy("_group").applyInArrow(pack, schema + ", sequence_id bigint, offset bigint")


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 0,
    group_rows: int = GROUP_ROWS,
    keep_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with their place: id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    pieces = materialise(pieces_of(docs, tokenizer_path, id_col, text_col, capacity, end_id, keep_ids), "pieces")
    return pack_pieces(pieces, id_col, capacity, group_rows)
