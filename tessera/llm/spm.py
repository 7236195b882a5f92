"""SentencePiece BPE encoding by backtracking over longest matches, and decoding.

Encoding follows the method of greedy longest matches with verification: an Aho-Corasick automaton proposes the
longest piece at a position; it may follow its left neighbour only if merging the two pieces' characters anew gives
just these two pieces back (what the pieces' inner edges go through while they are merged is kept for each piece, so
only merges across the border are looked at); if no piece fits, the position is marked in a bitfield of failed positions and the last
choice is shortened. The one sequence whose neighbours are all compatible is what merging the whole text gives.

The text is cut where no merge can reach across: before a run of blanks that follows another character (the
vocabulary is checked for it; otherwise nothing is cut), and around characters that are no piece. Segments are
memoised in a table of bounded size.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Memo

BLANK = "▁"
CODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PieceBpe:
    """`encode(text)` gives the ids that the sentencepiece library gives for a merge-type model with byte fallback."""

    def __init__(self, path: str, cap: int = 250_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only merge-type models with identity normalisation are supported")
        if any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces aren't supported")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.prefix = norm.add_dummy_prefix
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        normal = {p.piece: (p.score, i) for i, p in enumerate(model.pieces) if p.type == 1}
        self.score = {s: score for s, (score, _) in normal.items()}
        self.id = {s: i for s, (_, i) in normal.items()}
        times = Counter(self.score.values())
        tied = sorted((s for s, x in self.score.items() if len(s) > 1 and times[x] > 1), key=len)
        self.tied = re.compile("|".join(map(re.escape, tied))) if tied else None
        self.chars = {s for s in self.id if len(s) == 1}
        self.cuttable = not any(re.search(f"[^{BLANK}]{BLANK}", s) for s in self.id)
        self.lines = "\n" not in self.chars and not any("\n" in s for s in self.id)
        self.edges = BLANK + "\n" if self.lines else BLANK
        self.pair_ok: dict[tuple[str, str], bool] = Memo(self._compatible, 200_000)
        self.automaton = ahocorasick.Automaton()
        #: By piece: (part at that edge, level at which the part is merged away), from the character on.
        self.left_edge: dict[str, list[tuple[str, float]]] = {}
        self.right_edge: dict[str, list[tuple[str, float]]] = {}
        for s in self.id:
            left, right = [], []
            parts = self.merge(s, lambda parts, at, x, left=left, right=right: self._edges(parts, at, x, left, right))
            if len(parts) == 1:  # the others are never what merging ends with
                self.automaton.add_word(s, s)
                for edge, kept in ((left, self.left_edge), (right, self.right_edge)):
                    kept[s] = [(part, level) for part, level, touched in edge if touched] + [(s, float("-inf"))]
        self.automaton.make_automaton()
        #: The longest piece that a piece starts with, besides itself; empty if there is none.
        self.shorter = {s: next((s[:n] for n in range(len(s) - 1, 0, -1) if s[:n] in self.right_edge), "") for s in self.right_edge}
        self.memo = Memo(self._coded, cap)

    @staticmethod
    def _edges(parts: list[str], at: int, score: float, left: list, right: list) -> None:
        """Note a merge of parts[at] and parts[at + 1]; its level is the worst score so far, which it had to wait for."""
        level = min(score, left[-1][1]) if left else score
        left.append((parts[0], level, at == 0))
        right.append((parts[-1], level, at == len(parts) - 2))

    def _compatible(self, pair: tuple[str, str]) -> bool:
        """Whether merging the characters of both pieces gives the two pieces, by the merges at their border.

        An edge part is there until the level of the merge that takes it. A border merge of score s comes first if s
        is above the left part's level (of equal merges the left one goes first) and not below the right part's.
        """
        a, b = self.right_edge[pair[0]], self.left_edge[pair[1]]
        i = j = 0
        while True:
            (x, level_x), (y, level_y) = a[i], b[j]
            s = self.score.get(x + y)
            if s is not None and s > level_x and s >= level_y:
                return False
            if i + 1 == len(a) and j + 1 == len(b):
                return True
            if level_x >= level_y and i + 1 < len(a):
                i += 1
            else:
                j += 1

    def merge(self, text: str, note=None) -> list[str]:
        """Best-scored neighbours first, the left one of equals: the definition, for short strings."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            if note:
                note(parts, at, best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _merge_long(self, text: str) -> list[str]:
        """The same with a heap, for runs of pieces whose scores tie."""
        import heapq

        parts, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (s := self.score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if parts[i] != a or after[i] >= len(parts) or parts[j := after[i]] != b:
                continue
            parts[i], parts[j], after[i] = a + b, "", after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in parts if p]

    def backtrack(self, text: str) -> list[str]:
        """Pieces of a text whose characters are all pieces."""
        longest, fits, shorter, n = self.automaton.iter_long, self.pair_ok, self.shorter, len(text)
        failed = None  # a bitfield from the first failure on
        out: list[str] = []
        at, piece = 0, next(longest(text, 0))[1]
        while True:
            end = at + len(piece)
            if (not out or fits[out[-1], piece]) and not (failed and failed[end >> 3] >> (end & 7) & 1):
                out.append(piece)
                if end == n:
                    return out
                at = end
                piece = next(longest(text, at))[1]
                continue
            piece = shorter[piece]
            while not piece:  # no piece fits here: the last choice was wrong
                failed = failed or bytearray(n // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
                piece = shorter[piece]

    def segment(self, text: str) -> list[int]:
        """Ids of a segment that merges don't cross."""
        if self.chars.issuperset(text) and not (self.tied and self.tied.search(text)):
            return [self.id[p] for p in self.backtrack(text)]
        ids: list[int] = []
        run: list[str] = []

        def close() -> None:
            if run:
                s = "".join(run)
                tie = self.tied and self.tied.search(s)
                ids.extend(self.id[p] for p in (self._merge_long(s) if tie else self.backtrack(s)))
                run.clear()

        for c in text:
            if c in self.chars:
                run.append(c)
                continue
            close()
            ids.extend([self.byte[b] for b in c.encode("utf-8", "replace")] if self.byte else [self.unknown])
        close()
        return ids

    def _coded(self, segment: str) -> tuple[bytes, str]:
        """segment: what stood between two blanks, or a segment with its blanks or its line feed."""
        if segment[0] == "\0" and not self.prefix:
            segment = segment[1:]
        elif segment[0] not in self.edges:
            segment = BLANK + segment
        ids = self.segment(segment)
        return array("i", ids).tobytes(), ",".join(map(str, ids))

    def segments(self, text: str | None) -> list[str]:
        """Parts of the normalised text that are encoded on their own; a line feed that no piece holds also starts one."""
        if not text:
            return []
        if not self.cuttable:
            return [(BLANK if self.prefix else "") + text.replace(" ", BLANK)]
        if BLANK in text or "  " in text or " \n" in text or text[0] == " " or text[-1] == " ":
            text = (BLANK if self.prefix else "") + text.replace(" ", BLANK)
            return re.findall(f"{BLANK}*[^{BLANK}]+|{BLANK}+$", text)
        if self.lines:
            text = text.replace("\n", " \n")
            if text[0] == " ":  # the text starts with a line feed
                return [BLANK, *text[1:].split(" ")] if self.prefix else text[1:].split(" ")
        parts = text.split(" ")
        if not self.prefix:
            parts[0] = "\0" + parts[0]
        return parts

    def encode(self, text: str | None) -> list[int]:
        return array("i", b"".join([self.memo[s][0] for s in self.segments(text)])).tolist()

    def encode_joined(self, text: str | None) -> tuple[list[int], str]:
        """Ids, and the same in decimal, joined by commas."""
        found = [self.memo[s] for s in self.segments(text)]
        return array("i", b"".join([f[0] for f in found])).tolist(), ",".join([f[1] for f in found])

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids) if ids else ""


_cache: dict[str, PieceBpe] = {}


def piece_bpe(path: str) -> PieceBpe:
    """One encoder for each worker process and file."""
    if path not in _cache:
        _cache[path] = PieceBpe(path)
    return _cache[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and `ids` (array of int) of each whole text. A null text counts as empty and has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = piece_bpe(model)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                ids = [bpe.encode(t) for t in b.column(1).slice(at, 256).to_pylist()]
                yield pa.record_batch([b.column(0).slice(at, 256), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, model: str) -> DataFrame:
    """doc_id and `text` of rows (doc_id, ids); null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = piece_bpe(model)
        for b in batches:
            texts = [bpe.decode(i or []) for i in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Encode and decode in one pass, keeping digests: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty; repeated rows come out each; a null doc_id stays null; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = piece_bpe(model)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                n, a, d = [], [], []
                for t in b.column(1).slice(at, 1024).to_pylist():
                    ids, joined = bpe.encode_joined(t)
                    n.append(len(ids))
                    a.append(sha(joined))
                    d.append(sha(bpe.decode(ids)))
                yield pa.record_batch([b.column(0).slice(at, 1024), pa.array(n, pa.int64()), pa.array(a), pa.array(d)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, CODED)
