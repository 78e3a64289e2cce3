"""SentencePiece encoding and decoding with a prefix table of last tokens.

The merge encoding of a text has one last token, and so has that of each of
its prefixes.  A token can be the last of a prefix if an automaton over all
pieces ends a match there and the token is compatible with the last token of
the prefix before it: merging the two pieces' characters alone gives the two
back.  Filling this table from left to right and walking it backwards gives
the ids, without a queue of merges.

No piece crosses from a character to a space mark behind it, nor between
characters that stand side by side in no piece (both are read from the
vocabulary), so texts are cut there and each worker keeps the ids of the
pieces of text it has met.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from virosight.llm.worker import held, lean

SPACE = "▁"
#: Pieces of text, and token pairs, whose results a worker keeps.
CACHE_LIMIT = 300_000

_NEVER = 1 << 60
_START = -1


def default_model() -> str:
    """Path of the public 32k merge vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _merge(text: str, rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """Symbols after all merges, best rank and then leftmost first, and the last merge."""
    symbols, last = list(text), None
    while True:
        best = min(((r, i) for i in range(len(symbols) - 1) if (r := rank.get(symbols[i] + symbols[i + 1])) is not None), default=None)
        if best is None:
            return symbols, last
        i = best[1]
        last = symbols[i], symbols[i + 1]
        symbols[i : i + 2] = ["".join(last)]


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a serialised model part: varints as integers, strings and parts as bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def _only_marks(model: bytes) -> bool:
    """Does the model's normaliser (part 3) only put a space mark first and turn spaces to marks?

    Its fields: 2 a character map, 3 a mark is put first, 4 extra spaces go,
    5 spaces become marks; the last three hold unless the model says not.
    """
    part = dict(_fields(next((v for k, v in _fields(model) if k == 3), b"")))
    return not part.get(2) and bool(part.get(3, 1)) and not part.get(4, 1) and bool(part.get(5, 1))


class PieceTable:
    """Vocabulary, automaton and pair tests of one merge-type model."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normalize = lib.normalize
        n = lib.vocab_size()
        pieces = {i: lib.id_to_piece(i) for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))}
        self.bos, self.eos, self.unk = lib.bos_id(), lib.eos_id(), lib.unk_id()
        byte_ids = {int(lib.id_to_piece(i)[3:5], 16): i for i in range(n) if lib.is_byte(i)}
        self.byte_ids = [byte_ids.get(b) for b in range(256)] if len(byte_ids) == 256 else None
        self.surface = [b""] * n
        for i, p in pieces.items():
            self.surface[i] = p.replace(SPACE, " ").encode()
        for b, i in byte_ids.items():
            self.surface[i] = bytes([b])
        if self.unk >= 0:
            self.surface[self.unk] = " ⁇ ".encode()
        scores = sorted({lib.get_score(i) for i in pieces}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        self.rank = {p: place[lib.get_score(i)] for i, p in pieces.items()}
        self.text = pieces
        self.size = {i: len(p) for i, p in pieces.items()}
        self.known = {p for p in pieces.values() if len(p) == 1}
        self._derive()
        self.found = ahocorasick.Automaton()
        for i, p in pieces.items():
            if p not in self.unreachable:
                self.found.add_word(p, (len(p), i))
        self.found.make_automaton()
        self.plain = _only_marks(model)
        self.chunk = self._cut(pieces.values())
        self.compatible: dict[int, bool] = {}
        self.ids: dict[str, bytes] = {}

    @staticmethod
    def _cut(pieces) -> re.Pattern:
        """Pattern of the pieces of text that are encoded apart.

        Characters that stand side by side in some piece are of one kind.  The
        largest kind and all other characters never share a piece, so texts
        are cut between them, and before a space mark that follows others.
        """
        pieces = list(pieces)
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            return re.compile(r"(?s).+")
        kind: dict[str, str] = {}

        def root(c: str) -> str:
            while kind.setdefault(c, c) != c:
                c = kind[c]
            return c

        for p in pieces:
            chars = p.lstrip(SPACE)
            for c in chars[1:]:
                kind[root(c)] = root(chars[0])
        sizes = Counter(root(c) for c in kind)
        if not sizes:
            return re.compile("▁*[^▁]+|▁+")
        most = max(sizes, key=lambda c: (sizes[c], c))
        own = re.escape("".join(sorted(c for c in kind if root(c) == most)))
        return re.compile(f"▁*[{own}]+|▁*[^{own}▁]+|▁+")

    @staticmethod
    def _mark(text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def _derive(self) -> None:
        """Last merge of each piece, the pieces no merge order reaches, and those merged out of rank order."""
        split: dict[str, tuple[str, str] | None] = {}
        self.unreachable: set[str] = set()
        for p in self.rank:
            symbols, last = _merge(p, self.rank)
            split[p] = last
            if len(symbols) > 1:
                self.unreachable.add(p)
        uneven: set[str] = set()
        for p in sorted((p for p in split if split[p] and p not in self.unreachable), key=len):
            if any(len(x) > 1 and (self.rank[x] >= self.rank[p] or x in uneven) for x in split[p]):
                uneven.add(p)
        self.uneven = {i for i, p in self.text.items() if p in uneven}

        def spine(p: str, side: int) -> list[tuple[str, int, int]]:
            """The symbols at one edge of a piece: text, rank that makes it, rank that uses it up."""
            out, until = [], _NEVER
            while True:
                made = self.rank[p] if len(p) > 1 else -1
                out.append((p, made, until))
                if len(p) == 1:
                    return out
                p, until = split[p][side], made

        even = {i: p for i, p in self.text.items() if p not in self.unreachable and p not in uneven}
        self.right = {i: spine(p, 1) for i, p in even.items()}
        self.left = {i: spine(p, 0) for i, p in even.items()}

    def _fits(self, a: int, b: int) -> bool:
        """Do the characters of the two tokens merge to just these tokens?"""
        if a in self.uneven or b in self.uneven:
            return _merge(self.text[a] + self.text[b], self.rank)[0] == [self.text[a], self.text[b]]
        rank = self.rank
        for x, made_x, used_x in self.right[a]:
            for y, made_y, used_y in self.left[b]:
                # Both exist at a time; of merges of equal rank the left one comes first.
                if made_x <= used_y and made_y < used_x and (r := rank.get(x + y)) is not None and r < used_x and r <= used_y:
                    return False
        return True

    def _learn(self, chunks: list[str]) -> None:
        """Encode pieces of text that have no ids yet, all with one pass of the automaton."""
        runs: list[tuple[int, int]] = []
        parts: list[list] = []
        line: list[str] = []
        at = 0
        known = self.known
        for chunk in chunks:
            own: list = []
            begin = 0
            for k, c in enumerate(chunk):
                if c not in known:
                    if k > begin:
                        own.append((at, at + k - begin))
                        line.append(chunk[begin:k])
                        at += k - begin + 1
                    own.append(c)
                    begin = k + 1
            if len(chunk) > begin:
                own.append((at, at + len(chunk) - begin))
                line.append(chunk[begin:])
                at += len(chunk) - begin + 1
            parts.append(own)
            runs += [x for x in own if isinstance(x, tuple)]
        stop = "\n"
        while stop in known:
            stop = chr(ord(stop) + 1)
        last = [None] * (at + 1)
        for start, _ in runs:
            last[start] = _START
        compatible, fits = self.compatible, self._fits
        for end, (size, token) in self.found.iter(stop.join(line)):
            if last[end + 1] is not None:
                continue
            before = last[end + 1 - size]
            if before is None:
                continue
            if before != _START:
                pair = before << 20 | token
                good = compatible.get(pair)
                if good is None:
                    good = compatible[pair] = fits(before, token)
                if not good:
                    continue
            last[end + 1] = token
        width = self.size
        for chunk, own in zip(chunks, parts, strict=True):
            ids: list[int] = []
            for part in own:
                if isinstance(part, str):
                    ids += [self.byte_ids[b] for b in part.encode()] if self.byte_ids else [self.unk]
                    continue
                start, end = part
                back = []
                while end > start:
                    token = last[end]
                    if token is None:
                        raise ValueError("a prefix without a last token: the vocabulary is not of the merge type")
                    back.append(token)
                    end -= width[token]
                ids += reversed(back)
            self.ids[chunk] = b"".join(i.to_bytes(4, "little") for i in ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, with begin and end ids; null is empty."""
        if len(self.ids) > CACHE_LIMIT:
            self.ids.clear()
        if len(self.compatible) > 4 * CACHE_LIMIT:
            self.compatible.clear()
        out = []
        first, final = self.bos.to_bytes(4, "little"), self.eos.to_bytes(4, "little")
        for text in texts:
            marked = (self._mark(text) if self.plain else self.normalize(text)) if text else ""
            chunks = self.chunk.findall(marked)
            ids = self.ids
            try:
                body = b"".join([ids[c] for c in chunks])
            except KeyError:
                self._learn([c for c in dict.fromkeys(chunks) if c not in ids])
                body = b"".join([ids[c] for c in chunks])
            out.append(first + body + final)
        return out

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of packed ids: begin and end ids have none, and the space put before the text goes."""
        surface = self.surface
        text = b"".join([surface[i] for i in memoryview(ids).cast("I").tolist()])
        text = text[1:] if text[:1] == b" " else text
        try:
            text.decode()
            return text
        except UnicodeDecodeError:
            return text.decode("utf-8", "replace").encode()


def piece_table(model: bytes) -> PieceTable:
    """One table a worker."""
    return held("pieces", model, lambda: PieceTable(model))


def _model_bytes(model: str | None) -> bytes:
    with open(model or default_model(), "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """One row per row: ``id_col, n_tokens, ids_sha256, decoded_sha256, ids, decoded``.

    ``ids`` holds the packed ids and ``decoded`` the text they give back.  A
    null text counts as empty: begin and end ids only, and empty decoded
    text.  Whole texts of any length are encoded.  Equal rows stay; an empty
    table gives no row; other columns are not read.
    """
    proto = docs.sparkSession.sparkContext.broadcast(_model_bytes(model))
    schema = f"_id {dict(docs.dtypes)[id_col]}, ids binary, decoded string"

    @lean("pieces")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(proto.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = table.encode(part.column(1).to_pylist())
                text = pa.array([table.decode(x) for x in ids], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), text], names=["_id", "ids", "decoded"])

    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema)
    return _digests(out).withColumnRenamed("_id", id_col)


def _digests(out: DataFrame) -> DataFrame:
    return out.select(
        "_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "ids", "decoded",
    )


def token_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """``encode_documents`` without ids and text: digests are taken where the ids are made, so neither leaves the worker."""
    proto = docs.sparkSession.sparkContext.broadcast(_model_bytes(model))
    schema = f"_id {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    @lean("pieces")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(proto.value)
        for batch in batches:
            counts, first, second = [], [], []
            for k in range(0, batch.num_rows, 256):
                for ids in table.encode(batch.column(1).slice(k, 256).to_pylist()):
                    counts.append(len(ids) // 4)
                    first.append(hashlib.sha256(ids).hexdigest())
                    second.append(hashlib.sha256(table.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=["_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``token_digests`` of all of ``documents`` with the public 32k merge model; odd rows as in ``encode_documents``."""
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
