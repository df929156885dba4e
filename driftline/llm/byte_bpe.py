"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside Spark tasks.

Spark cuts the work: each task takes its documents in slices, splits every text by the pattern, and hands the
distinct matches it has not met lately to a DuckDB database of its own. There a match is one row per token and position.
A recursive query joins neighbouring tokens with the merge table and contracts each word's leftmost pair of minimum
rank, until no pair is left. The tokens left come back ordered by word and position; in that order ids are listed and
the bytes that they decode to joined. A match that is a token itself takes its id at once, as the rank file's library does.

A long match (Chinese text without blanks, say) is first cut wherever no token of the vocabulary that occurs in it lies across:
no contraction ever joins the two sides there. What is still long after that has one contraction a round only where it must: all places of
the minimum pair are contracted at once unless the new token forms a pair of a lower rank with some neighbour in the vocabulary.

Queries are cut by bytes, so the database stays small and needs no folder to spill to.

Defined cases: null text is empty and has no tokens; text in any script and of any length is encoded whole; null ids and
repeated rows are kept; no rows give no rows. Columns other than id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from driftline.llm.common import text_slices

LONG_WORD = 64  # bytes
CACHED_WORDS = 250_000  # of each of two generations
QUERY_BYTES = 1_000_000

_STEP = """
    WITH RECURSIVE step(i, w, p, t, nxt) AS (
        SELECT 0, w, p, t, nxt FROM bytes
        UNION ALL
        SELECT i + 1, w, CASE WHEN p > place THEN p - 1 ELSE p END, CASE WHEN p = place + 1 THEN made ELSE t END,
               CASE WHEN p = place - 1 THEN made ELSE nxt END
        FROM step JOIN (
            SELECT w, (min(rank::BIGINT << 32 | p) & 4294967295)::INT AS place, (min(rank::BIGINT << 32 | p) >> 32)::INT AS made
            FROM step JOIN merges ON pair = (t::BIGINT << 20 | nxt) GROUP BY w
        ) USING (w)
        WHERE p <> place
    )
"""

# As above; overlapping places are taken alternately from the left, and only the leftmost one where `alone` is set.
_LONG_STEP = """
    WITH RECURSIVE step(i, w, p, t, nxt) AS (
        SELECT 0, w, p, t, nxt FROM bytes
        UNION ALL
        SELECT * FROM (
            WITH pairs AS (SELECT w, p, rank, alone FROM step JOIN merges ON pair = (t::BIGINT << 20 | nxt)),
            least AS (SELECT w, min(rank) AS rank FROM pairs GROUP BY w),
            places AS (
                SELECT w, p, rank, alone, p - row_number() OVER (PARTITION BY w ORDER BY p) AS run,
                       min(p) OVER (PARTITION BY w) AS lowest
                FROM pairs JOIN least USING (w, rank)
            ),
            runs AS (SELECT *, min(p) OVER (PARTITION BY w, run) AS first FROM places),
            cuts AS (
                SELECT w, p, rank FROM runs
                WHERE CASE WHEN alone THEN p = lowest ELSE (p - first) % 2 = 0 END
            ),
            joined AS (
                SELECT s.i + 1 AS i, s.w, s.p, coalesce(c.rank, s.t) AS t
                FROM step s JOIN least USING (w) LEFT JOIN cuts c ON c.w = s.w AND c.p = s.p
                WHERE NOT EXISTS (FROM cuts d WHERE d.w = s.w AND d.p + 1 = s.p)
            )
            SELECT i, w, (row_number() OVER same - 1)::INT, t, coalesce(lead(t) OVER same, -1)
            FROM joined WINDOW same AS (PARTITION BY w ORDER BY p)
        )
    )
"""

_RESULT = """
    , last AS (SELECT w, max(i) AS i FROM step WHERE p = 0 GROUP BY w)
    SELECT w, t FROM step JOIN last USING (w, i) ORDER BY w, p
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class DuckEncoder:
    """Ids and decoded bytes of pattern matches, from a database in memory with one thread."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.pattern = regex.compile(pattern)
        self.ranks = read_ranks(path)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        rows = [
            (left << 20 | right, rank, left, right)
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if (left := self.ranks.get(token[:cut])) is not None and (right := self.ranks.get(token[cut:])) is not None
        ]
        lowered = {part for _, rank, left, right in rows for part in (left, right) if rank < part}
        self.starts = {token[:k] for token in self.ranks for k in range(1, len(token))}  # proper beginnings of tokens
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        merges = pa.table({"pair": [r[0] for r in rows], "rank": [r[1] for r in rows], "alone": [r[1] in lowered for r in rows]})
        self.db.register("given_merges", merges)
        self.db.execute("CREATE TABLE merges AS SELECT pair, rank::INT AS rank, alone FROM given_merges")
        self.db.execute("SET preserve_insertion_order = false")
        self.known: dict[str | bytes, tuple[str, bytes]] = {}
        self.older: dict[str | bytes, tuple[str, bytes]] = {}

    def cut(self, raw: bytes) -> list[bytes]:
        """A word in parts that no contraction joins: cut wherever no token that occurs in it lies across."""
        parts, begin, reach = [], 0, 0  # tokens found so far lie before `reach`
        for at in range(len(raw)):
            if at >= reach and at > begin:
                parts.append(raw[begin:at])
                begin = at
            end = at + 1
            while end <= len(raw) and raw[at:end] in self.starts:
                end += 1
                if raw[at:end] in self.ranks:
                    reach = max(reach, min(end, len(raw)))
        return [*parts, raw[begin:]]

    def learn(self, matches: set[str]) -> None:
        """Make ids and bytes of these matches known; those met lately need no query."""
        fresh = matches.difference(self.known)
        if len(self.known) + len(fresh) > CACHED_WORDS:
            self.older, self.known = self.known, {}
            fresh = matches
        words: dict[bytes, str] = {}
        for match in fresh:
            if (old := self.older.get(match)) is not None:
                self.known[match] = old
                continue
            raw = match.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                self.known[match] = str(rank), self.bytes_of[rank]
            else:
                words[raw] = match
        parts = {raw: self.cut(raw) for raw in words if len(raw) > LONG_WORD}
        search = {raw for raw in words if raw not in parts} | {p for cut in parts.values() for p in cut if p not in self.ranks}
        found: dict[bytes, tuple[str, bytes]] = {}
        for long, step in ((False, _STEP), (True, _LONG_STEP)):
            batch, size = [], 0
            for raw in search:
                if (len(raw) > LONG_WORD) == long:
                    if batch and size + len(raw) > QUERY_BYTES:
                        self._contract(batch, step, found)
                        batch, size = [], 0
                    batch.append(raw)
                    size += len(raw)
            if batch:
                self._contract(batch, step, found)
        for raw, match in words.items():
            if raw in parts:
                each = [found[p] if p in found else (str(self.ranks[p]), p) for p in parts[raw]]
                self.known[match] = " ".join(ids for ids, _ in each), b"".join(x for _, x in each)
            else:
                self.known[match] = found[raw]

    def _contract(self, words: list[bytes], step: str, found: dict[bytes, tuple[str, bytes]]) -> None:
        lengths = np.array([len(raw) for raw in words])
        ends = np.cumsum(lengths)
        tokens = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        following = np.append(tokens[1:], -1).astype(np.int32)
        following[ends - 1] = -1
        place = np.arange(len(tokens)) - np.repeat(ends - lengths, lengths)
        word = np.repeat(np.arange(len(words)), lengths)
        rows = pa.table({"w": word.astype(np.int32), "p": place.astype(np.int32), "t": tokens, "nxt": following})
        self.db.register("bytes", rows)
        result = self.db.execute(step + _RESULT).fetchnumpy()
        self.db.unregister("bytes")
        ids = result["t"].tolist()
        texts, pieces = list(map(str, ids)), list(map(self.bytes_of.__getitem__, ids))
        bounds = np.searchsorted(result["w"], np.arange(len(words) + 1)).tolist()
        for raw, a, b in zip(words, bounds, bounds[1:]):
            found[raw] = " ".join(texts[a:b]), b"".join(pieces[a:b])


_encoders: dict[tuple[str, str], DuckEncoder] = {}


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False
) -> DataFrame:
    """id, n_tokens, ids (array) and decoded (binary) of every text; with `digests` SHA-256 of both instead:
    ids_sha256 over the decimal ids joined by one space, decoded_sha256 over the bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (ranks_path, pattern)
        if key not in _encoders:
            _encoders[key] = DuckEncoder(*key)
        encoder = _encoders[key]
        for batch in text_slices(batches, text_col, 4_000_000):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            split = [encoder.pattern.findall(t or "") for t in texts]
            encoder.learn(set().union(*split))
            known = [list(map(encoder.known.__getitem__, s)) for s in split]
            ids = [" ".join([x for x, _ in k]) for k in known]
            decoded = [b"".join([x for _, x in k]) for k in known]
            counts = [x.count(" ") + 1 if x else 0 for x in ids]
            columns = {id_col: batch.column(batch.schema.get_field_index(id_col)), "n_tokens": pa.array(counts, pa.int64())}
            if digests:
                columns["ids_sha256"] = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids])
                columns["decoded_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in decoded])
            else:
                columns["ids"] = pa.array([[int(i) for i in x.split()] for x in ids], pa.list_(pa.int32()))
                columns["decoded"] = pa.array(decoded, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema[id_col].dataType.simpleString()
    result = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, {result}")
