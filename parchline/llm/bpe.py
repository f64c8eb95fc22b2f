"""Byte-level BPE encoding and decoding with DuckDB recursive queries.

Each partition's Python worker holds one DuckDB connection with the merge table
(left token, right token, merged token; a merged token's id is its rank). A
recursive query keeps one row for each token and position of a word, joins
neighbours to the merge table and contracts the pair of minimum rank, leftmost
first, until no word changes. An ordered aggregation over the token rows decodes.

Exactness. The text is split by the pattern first; each match is encoded alone, and
a match that is itself in the vocabulary is one token. In words under LONG bytes one pair
contracts in a step. In longer ones every pair does whose turn comes whatever happens
elsewhere: no token of lower rank could still stand over the border of the pair and one of its
halves, nor over the pair and more. Such a token would have to begin and end at
borders that are left, so all its places are found once, by walks down the vocabulary's trie.
Of equal pairs in a row, the first of which is sure, every second one contracts; where no pair is sure, the leftmost one
of minimum rank does. Steps of one query are limited; what isn't finished starts the next query.
Memory is bounded but for a single word of hundreds of kilobytes without any break, whose places have to fit.

Defined results. Null and empty texts have no tokens and decode to empty bytes. Repeated
rows and null ids are encoded row by row; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, with_id

#: Steps of one recursive query.
STEPS = 24
#: Bytes of words, and tokens, in one query; words remembered by a worker.
QUERY_BYTES, QUERY_TOKENS, REMEMBERED = 1 << 18, 1 << 18, 400_000

#: Bytes from which a word counts as long; bytes of long words in one query, and of a walk's beginnings.
LONG, LONG_BYTES = 48, 1 << 15
#: Memory of a worker's database, and bytes of a single long word for which it may have a megabyte more.
MEMORY_MB, WORD_BYTES_A_MB = 192, 600

#: One pair of each word contracts in a step; positions stay 0, 1, 2 ... within a word.
_SHORT = f"""
WITH RECURSIVE step(depth, done, w, pos, tok) AS (
    SELECT 0, false, w, pos, tok FROM start
    UNION ALL
    (
        WITH pair AS (
            SELECT a.w, min(m.merged * {LONG}::INT + a.pos) AS best
            FROM step a JOIN step b ON b.w = a.w AND b.pos = a.pos + 1 JOIN merges m ON m.l = a.tok AND m.r = b.tok
            WHERE NOT a.done AND NOT b.done
            GROUP BY a.w
        )
        SELECT depth + 1, best IS NULL, s.w,
            CASE WHEN pos > best % {LONG} THEN pos - 1 ELSE pos END,
            CASE WHEN pos = best % {LONG} THEN best // {LONG} ELSE tok END
        FROM step s LEFT JOIN pair ON pair.w = s.w
        WHERE NOT done AND depth < {LONG} AND pos IS DISTINCT FROM best % {LONG} + 1
    )
)
SELECT w, tok, done FROM step WHERE done ORDER BY w, pos
"""

#: Where tokens of two bytes and more could stand in long words: walks down the vocabulary's trie from every byte.
_PLACES = """
WITH RECURSIVE walk(w, s, e, node, id) AS (
    SELECT b.w, b.at, b.at + 1, t.child, NULL::INT FROM bytes b JOIN trie t ON t.node = 0 AND t.byte = b.byte
    WHERE b.at >= ? AND b.at < ?
    UNION ALL
    SELECT k.w, k.s, k.e + 1, t.child, t.id
    FROM walk k JOIN bytes b ON b.at = k.e AND b.w = k.w JOIN trie t ON t.node = k.node AND t.byte = b.byte
)
INSERT INTO places SELECT s, e, id FROM walk WHERE id IS NOT NULL
"""

#: For long words: in each step all pairs contract that are sure to, whatever happens elsewhere.
_LONG = f"""
WITH RECURSIVE step(depth, done, w, s, e, tok) AS (
    SELECT 0, false, w, s, e, tok FROM start
    UNION ALL
    (
        WITH live AS (
            SELECT *, row_number() OVER (ORDER BY s) AS rn FROM step WHERE NOT done AND depth < {STEPS}
        ), crossing AS (
            SELECT a.rn AS first, b.rn AS last, o.id FROM places o JOIN live a ON a.s = o.s JOIN live b ON b.e = o.e WHERE b.rn > a.rn
        ), begin AS (
            SELECT first AS rn, min(id) AS two, min(CASE WHEN last > first + 1 THEN id END) AS three FROM crossing GROUP BY first
        ), finish AS (
            SELECT last AS rn, min(id) AS two, min(CASE WHEN last > first + 1 THEN id END) AS three FROM crossing GROUP BY last
        ), pair AS (
            SELECT a.w, a.rn, m.merged, coalesce(fa.two = m.merged, false) AS tie,
                coalesce(fa.two >= m.merged, true) AND coalesce(bb.two >= m.merged, true)
                AND coalesce(fb.three > m.merged, true) AND coalesce(ba.three > m.merged, true) AS hit
            FROM live a JOIN live b ON b.rn = a.rn + 1 AND b.w = a.w JOIN merges m ON m.l = a.tok AND m.r = b.tok
            LEFT JOIN finish fa ON fa.rn = a.rn LEFT JOIN finish fb ON fb.rn = b.rn
            LEFT JOIN begin ba ON ba.rn = a.rn LEFT JOIN begin bb ON bb.rn = b.rn
        ), linked AS (
            SELECT *, CASE WHEN hit AND lag(hit) OVER o AND lag(merged) OVER o = merged AND lag(rn) OVER o = rn - 1 THEN 0 ELSE 1 END AS fresh
            FROM pair WINDOW o AS (ORDER BY rn)
        ), runs AS (
            SELECT *, sum(fresh) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING) AS run FROM linked
        ), judged AS (
            SELECT w, rn, merged, hit AND NOT first(tie) OVER o AND (rn - first(rn) OVER o) % 2 = 0 AS sure
            FROM runs WINDOW o AS (PARTITION BY run ORDER BY rn)
        ), taken AS (
            SELECT rn, merged
            FROM (SELECT *, bool_or(sure) OVER (PARTITION BY w) AS settled, row_number() OVER (PARTITION BY w ORDER BY merged, rn) AS turn FROM judged)
            WHERE sure OR (NOT settled AND turn = 1)
        )
        SELECT l.depth + 1, c.w IS NULL, l.w, l.s, CASE WHEN t.rn IS NULL THEN l.e ELSE n.e END, coalesce(t.merged, l.tok)
        FROM live l LEFT JOIN (SELECT DISTINCT w FROM pair) c ON c.w = l.w LEFT JOIN taken t ON t.rn = l.rn
        LEFT JOIN taken gone ON gone.rn = l.rn - 1 LEFT JOIN live n ON n.rn = l.rn + 1
        WHERE gone.rn IS NULL
    )
)
SELECT w, s, e, tok, done FROM step WHERE done OR depth = {STEPS} ORDER BY s
"""

_DECODE = """
SELECT doc, from_hex(string_agg(hex, '' ORDER BY pos)) AS bytes FROM tokens t JOIN vocabulary v ON v.id = t.id GROUP BY doc ORDER BY doc
"""


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id from a rank file (base64 bytes and rank on each line)."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    out = [b""] * (1 + max(int(r) for _, r in pairs))
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class Codec:
    """A vocabulary, its merge table and what this worker has encoded before."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import duckdb
        import regex

        self.split = regex.compile(pattern)
        rank = {t: i for i, t in enumerate(tokens) if t}
        self.known = {t: np.uint32(i).tobytes() for t, i in rank.items()}
        self.byte = np.array([rank.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        left, right, merged = [], [], []
        for token, i in rank.items():
            for k in range(1, len(token)):
                a, b = rank.get(token[:k]), rank.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(i)
        l, r, m = (np.array(x, dtype=np.int32) for x in (left, right, merged))
        self.db = duckdb.connect()
        self.db.execute("SET threads = 1")
        self.db.execute(f"SET memory_limit = '{MEMORY_MB}MB'")
        self.db.execute("SET temp_directory = ''")  # nothing is written to the machine's folders
        self.tokens, self.sizes = tokens, np.array([len(t) for t in tokens], dtype=np.int64)
        self.load("merges", {"l": l, "r": r, "merged": m})
        self.load("vocabulary", {"id": np.arange(len(tokens), dtype=np.int32), "hex": [t.hex() for t in tokens]})
        self.cache: dict[str, bytes] = {}
        self.remembered = REMEMBERED
        self.ready = False

    def load(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def build_trie(self) -> None:
        """The vocabulary's trie, for long words only: one row for each node, by its parent and byte."""
        if self.ready:
            return
        nodes: dict[tuple[int, int], int] = {}
        ids: dict[int, int] = {}
        for i, token in enumerate(self.tokens):
            node = 0
            for b in token:
                node = nodes.setdefault((node, b), len(nodes) + 1)
            if len(token) > 1:
                ids[node] = i
        columns = {
            "node": np.array([k for k, _ in nodes], dtype=np.int32),
            "byte": np.array([b for _, b in nodes], dtype=np.uint8),
            "child": np.array(list(nodes.values()), dtype=np.int32),
            "id": pa.array([ids.get(c) for c in nodes.values()], pa.int32()),
        }
        self.load("trie", columns)
        self.ready = True

    def contract(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of words by the recursive query."""
        sizes = np.array([len(w) for w in words])
        if sizes.min() < LONG <= sizes.max():
            out = [b""] * len(words)
            for part in (np.flatnonzero(sizes < LONG), np.flatnonzero(sizes >= LONG)):
                for i, ids in zip(part, self.contract([words[i] for i in part])):
                    out[i] = ids
            return out
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        tok = self.byte[data]
        if (tok < 0).any():
            raise ValueError("the vocabulary lacks single bytes of the text")
        if sizes.max() >= LONG:
            return self.contract_long(words, data, tok, sizes)
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        first = np.cumsum(sizes) - sizes
        pos = (np.arange(len(tok)) - np.repeat(first, sizes)).astype(np.int32)
        self.db.register("start", pa.table({"w": word, "pos": pos, "tok": tok}))
        got = self.db.execute(_SHORT).fetchnumpy()
        self.db.unregister("start")
        out: list[bytes] = [b""] * len(words)
        self.deal(out, np.ascontiguousarray(got["w"]), np.ascontiguousarray(got["tok"]))
        return out

    @staticmethod
    def deal(out: list[bytes], word: np.ndarray, tok: np.ndarray) -> None:
        """Ids of finished words, which lie together, to their places."""
        cuts = np.flatnonzero(np.diff(word)) + 1
        for k, part in zip(word[np.concatenate(([0], cuts))] if len(word) else (), np.split(tok.astype("<u4"), cuts)):
            out[k] = part.tobytes()

    def contract_long(self, words: list[bytes], data: np.ndarray, tok: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        if len(words) > 1 and len(data) > LONG_BYTES:  # a query holds LONG_BYTES or one word
            group = (np.cumsum(sizes) - sizes) // LONG_BYTES
            for part in np.split(np.arange(len(words)), np.flatnonzero(np.diff(group)) + 1):
                if len(part) < len(words):
                    for i, ids in zip(part, self.contract([words[i] for i in part])):
                        out[i] = ids
                    continue
                half = len(part) // 2
                return self.contract(words[:half]) + self.contract(words[half:])
            return out
        self.build_trie()
        self.db.execute(f"SET memory_limit = '{MEMORY_MB + len(data) // WORD_BYTES_A_MB}MB'")
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        at = np.arange(len(tok), dtype=np.int32)
        self.load("bytes", {"w": word, "at": at, "byte": data})
        self.db.execute("CREATE OR REPLACE TABLE places (s INT, e INT, id INT)")
        for low in range(0, len(data), LONG_BYTES):
            self.db.execute(_PLACES, [low, low + LONG_BYTES])
        start = at
        while len(tok):
            end = (start + self.sizes[tok]).astype(np.int32)
            self.db.register("start", pa.table({"w": word, "s": start, "e": end, "tok": tok}))
            got = self.db.execute(_LONG).fetchnumpy()
            self.db.unregister("start")
            word, start, tok, done = (np.ascontiguousarray(got[k]) for k in ("w", "s", "tok", "done"))
            self.deal(out, word[done], tok[done])
            word, start, tok = word[~done].astype(np.int32), start[~done].astype(np.int32), tok[~done].astype(np.int32)
        self.db.execute("DROP TABLE bytes; DROP TABLE places")
        self.db.execute(f"SET memory_limit = '{MEMORY_MB}MB'")
        return out

    def learn(self, words: set[str]) -> None:
        held: list[str] = []
        size = 0
        for word in [*words, None]:
            if held and (word is None or size >= QUERY_BYTES):
                self.cache.update(zip(held, self.contract([w.encode("utf-8", "replace") for w in held])))
                held, size = [], 0
            if word is None:
                break
            data = word.encode("utf-8", "replace")
            if data in self.known:
                self.cache[word] = self.known[data]
            else:
                held.append(word)
                size += len(data)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; longer texts go by runs of matches."""
        out: list[list[bytes]] = [[] for _ in texts]
        runs: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            nonlocal runs, size
            if len(self.cache) > self.remembered:
                self.cache.clear()
            self.learn(set(chain.from_iterable(ws for _, ws in runs)).difference(self.cache))
            for i, ws in runs:
                out[i].append(b"".join(map(self.cache.__getitem__, ws)))
            runs, size = [], 0

        for i, text in enumerate(texts):
            if not text:
                continue
            matches = (m.group() for m in self.split.finditer(text)) if len(text) > QUERY_TOKENS else None
            if matches is None:
                runs.append((i, self.split.findall(text)))
                size += len(runs[-1][1])
                if size >= QUERY_TOKENS:
                    flush()
            else:
                while ws := list(islice(matches, QUERY_TOKENS)):
                    runs.append((i, ws))
                    flush()
        flush()
        return [b"".join(x) for x in out]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each id sequence by an ordered aggregation; a longer sequence goes by parts."""
        out: list[list[bytes]] = [[] for _ in ids]
        parts = [(i, x[k : k + 4 * QUERY_TOKENS]) for i, x in enumerate(ids) for k in range(0, len(x), 4 * QUERY_TOKENS)]
        at = 0
        while at < len(parts):
            end, size = at, 0
            while end < len(parts) and (end == at or size + len(parts[end][1]) <= 4 * QUERY_TOKENS):
                size += len(parts[end][1])
                end += 1
            tok = np.frombuffer(b"".join(x for _, x in parts[at:end]), dtype="<u4").astype(np.int32)
            doc = np.repeat(np.arange(end - at, dtype=np.int32), [len(x) // 4 for _, x in parts[at:end]])
            rows = pa.table({"doc": doc, "pos": np.arange(len(tok), dtype=np.int32), "id": tok})
            self.db.register("tokens", rows)
            got = self.db.execute(_DECODE).fetchall()
            self.db.unregister("tokens")
            for k, data in got:
                out[parts[at + k][0]].append(data)
            at = end
        return [b"".join(x) for x in out]


_CODECS: dict[tuple, Codec] = {}


def _codec(vocabulary, pattern: str) -> Codec:
    """One codec for each vocabulary, known by its digest, and worker; workers outlive tasks."""
    digest, tokens = vocabulary.value
    if (digest, pattern) not in _CODECS:
        _CODECS.clear()
        _CODECS[digest, pattern] = Codec(tokens, pattern)
    return _CODECS[digest, pattern]


def _shared(spark, path: str):
    """The vocabulary and its digest, broadcast: its size is the vocabulary's, whatever the data."""
    tokens = read_ranks(path)
    whole = b"".join(len(t).to_bytes(4, "little") + t for t in tokens)
    return spark.sparkContext.broadcast((hashlib.blake2b(whole, digest_size=16).hexdigest(), tokens))


def id_lists(ids: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))


def _kernel(tokens, pattern: str, decode: bool, lists: bool, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(tokens, pattern)
        codec.remembered = remembered
        for batch in batches:
            ids = codec.encode(batch.column("text").to_pylist())
            columns = {"doc_id": batch.column("doc_id"), "ids": id_lists(ids) if lists else pa.array(ids, pa.binary())}
            if decode:
                columns["decoded"] = pa.array(codec.decode(ids), pa.binary())
            yield pa.record_batch(columns)

    return run


def encode(
    df: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    decode_back: bool = False,
    lists: bool = False,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """doc_id, ids (binary: little-endian 32-bit ids; with ``lists`` an array of int), n_tokens; with decode_back the decoded bytes too.

    The rank file is read on the driver. ``remembered`` bounds the words a worker keeps: fewer need less memory and more time, the ids stay the same.
    """
    spark = df.sparkSession
    small_batches(spark)
    tokens = _shared(spark, ranks_path)
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = with_id(docs, f"ids {'array<int>' if lists else 'binary'}" + ", decoded binary" * decode_back)
    out = docs.mapInArrow(_kernel(tokens, pattern, decode_back, lists, remembered), schema)
    return out.withColumn("n_tokens", (F.size("ids") if lists else F.length("ids") / 4).cast("bigint"))


def _decoder(tokens, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(tokens, pattern)
        for batch in batches:
            ids = [b"" if x is None else x for x in batch.column("ids").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "decoded": pa.array(codec.decode(ids), pa.binary())})

    return run


def decode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded (binary) of a column of little-endian 32-bit ids."""
    spark = df.sparkSession
    small_batches(spark)
    tokens = _shared(spark, ranks_path)
    given = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return given.mapInArrow(_decoder(tokens, r"\s+|\S+"), with_id(given, "decoded binary"))
