"""Token budget of every source, language and domain under an existing subword vocabulary.

A double-array trie over the vocabulary is walked by a dynamic program that keeps, for every position of a
normalised segment, only the number of tokens of the best path to it; the path itself is never built. With a
unigram vocabulary the best path is the most probable one (Viterbi). The public vocabularies here are merge
vocabularies, whose pieces have ranks and no probabilities; for them a step to a piece is allowed only after the
one piece with which merging leaves it side by side, so that exactly one path remains and its length is the
tokenizer's own count, not an estimate.

A text is cut into segments where no piece of the vocabulary can reach across; a segment is counted once a task and
its count kept.

Defined cases: null and empty texts have no tokens; characters outside the vocabulary count as their bytes; null,
empty or unreadable languages, sources and domains are the slice "unknown"; repeated rows count each.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import UNKNOWN, language, source_key, spread

VOCABULARY = "piece_bpe_32k.model"
BLANK = "▁"


class DoubleArray:
    """Trie of pieces in two arrays: a child of state s by character c is t = base[s] + c where check[t] == s."""

    def __init__(self, pieces: Sequence[str]) -> None:
        alphabet = sorted({c for p in pieces for c in p})
        self.code = {c: i + 1 for i, c in enumerate(alphabet)}
        tree: list[dict[int, int]] = [{}]
        value = [-1]
        for i, piece in enumerate(pieces):
            at = 0
            for c in piece:
                step = self.code[c]
                if step not in tree[at]:
                    tree[at][step] = len(tree)
                    tree.append({})
                    value.append(-1)
                at = tree[at][step]
            value[at] = i
        size = 2 * len(tree) + 4 * len(alphabet) + 8192
        base, check, term = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = np.zeros(size, bool)
        place = {0: 0}
        check[0], used[0] = 0, True
        free = 1
        fan: dict[int, int] = {}  # by number of children: where the last such node found room
        queue = [0]
        for node in queue:  # breadth first
            here = place[node]
            term[here] = value[node]
            kids = sorted(tree[node])
            if not kids:
                continue
            if len(kids) == 1:
                while used[free] or free < kids[0] + 1:
                    free += 1
                b = free - kids[0]
            else:
                b = self._room(used, kids, max(fan.get(min(len(kids), 64), 1), 1))
                fan[min(len(kids), 64)] = b
            base[here] = b
            for k in kids:
                used[b + k] = True
                check[b + k] = here
                place[tree[node][k]] = b + k
                queue.append(tree[node][k])
        self.base, self.check, self.term = base.tolist(), check.tolist(), term.tolist()

    @staticmethod
    def _room(used: np.ndarray, kids: list[int], start: int) -> int:
        """The first base from `start` on at which every child's place is free, found a stretch of bases at a time."""
        span = 4096
        while True:
            taken = used[start + kids[0] : start + kids[0] + span].copy()
            for k in kids[1:]:
                other = used[start + k : start + k + span]
                taken = taken[: len(other)] | other
            if len(taken) and not taken.all():
                return start + int(taken.argmin())
            if len(taken) < span:
                raise ValueError("the trie has outgrown its arrays")
            start += span

    def matches(self, text: str, start: int) -> Iterator[tuple[int, int]]:
        """End and number of every piece that begins at `start`."""
        at, base, check, term, code = 0, self.base, self.check, self.term, self.code
        for i in range(start, len(text)):
            c = code.get(text[i])
            if c is None:
                return
            nxt = base[at] + c
            if nxt >= len(check) or check[nxt] != at:
                return
            at = nxt
            if term[at] >= 0:
                yield i + 1, term[at]


def viterbi_count(text: str, trie: DoubleArray, scores: Sequence[float], unknown: float = -20.0) -> int:
    """Tokens on the most probable path of a unigram vocabulary; a character outside it is one token."""
    n = len(text)
    best = [float("-inf")] * (n + 1)
    count = [0] * (n + 1)
    best[0] = 0.0
    for i in range(n):
        here = best[i]
        single = False
        for j, piece in trie.matches(text, i):
            single = single or j == i + 1
            if (s := here + scores[piece]) > best[j]:
                best[j], count[j] = s, count[i] + 1
        if not single and (s := here + unknown) > best[i + 1]:
            best[i + 1], count[i + 1] = s, count[i] + 1
    return count[n]


class MergeCounter(dict):
    """Token counts of segments under a merge vocabulary, kept up to a bound."""

    KEPT = 500_000

    def __init__(self, pieces: Sequence[str], scores: Sequence[float]) -> None:
        super().__init__()
        self.pieces = list(pieces)
        self.rank = {p: s for p, s in zip(pieces, scores, strict=True)}
        self.trie = DoubleArray(self.pieces)
        self.beside: dict[tuple[int, int], bool] = {}
        met = {(a, b) for p in pieces for a, b in zip(p, p[1:], strict=False)}
        joined = {c for pair in met for c in pair}
        # characters that no piece joins to another stand alone; a run of blanks goes with the word after it
        alone = "".join(c for c in map(chr, [*range(0x2E80, 0xA000), *range(0xAC00, 0xD7A4), *range(0xF900, 0xFB00), *range(0xFF00, 0xFFF0)]) if c not in joined)
        self.alone = re.compile("([" + re.escape(alone) + "])") if alone else None
        self.segments = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
        self.word = re.compile(f"{BLANK}*[^\\W\\d_{BLANK}]+|{BLANK}*.[^\\w{BLANK}]*|{BLANK}+", re.S)

    def side_by_side(self, a: int, b: int) -> bool:
        """Whether merging the two pieces' text leaves just these two."""
        key = (a, b)
        if (known := self.beside.get(key)) is None:
            known = self.beside[key] = self.merged(self.pieces[a] + self.pieces[b]) == [self.pieces[a], self.pieces[b]]
        return known

    def merged(self, text: str) -> list[str]:
        """Merges by the best score and then from the left; for two pieces only."""
        parts: list[str] = list(text)
        rank = self.rank
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        alive = [True] * len(parts)
        heap = [(-rank[p], i, i + 1, p) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in rank]
        heapq.heapify(heap)
        while heap:
            _, i, j, p = heapq.heappop(heap)
            if not (alive[i] and j < len(parts) and alive[j]) or after[i] != j or parts[i] + parts[j] != p:
                continue
            parts[i], alive[j] = p, False
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
                if (q := p + parts[after[i]]) in rank:
                    heapq.heappush(heap, (-rank[q], i, after[i], q))
            if before[i] >= 0 and (q := parts[before[i]] + p) in rank:
                heapq.heappush(heap, (-rank[q], before[i], i, q))
        return [p for p, a in zip(parts, alive, strict=True) if a]

    def count(self, segment: str) -> int:
        """Tokens of a segment: for every position the one piece that ends there, and how many lead to it."""
        n = len(segment)
        last = [-2] * (n + 1)  # -1: nothing before; -2: not reached
        tokens = [0] * (n + 1)
        last[0] = -1
        for i in range(n):
            if last[i] == -2:
                continue
            single = False
            for j, piece in self.trie.matches(segment, i):
                single = single or j == i + 1
                if last[j] == -2 and (last[i] == -1 or self.side_by_side(last[i], piece)):
                    last[j], tokens[j] = piece, tokens[i] + 1
            if not single and last[i + 1] == -2:  # a character without a piece: its bytes, and nothing merges with them
                last[i + 1], tokens[i + 1] = -1, tokens[i] + len(segment[i].encode("utf-8", "replace"))
        return tokens[n]

    def __missing__(self, segment: str) -> int:
        n = self.count(segment)
        if len(segment) <= 32 and len(self) < self.KEPT:
            self[segment] = n
        return n

    def tokens(self, text: str) -> int:
        """Tokens of a whole text, after the normalisation of the vocabulary: a blank before it, blanks as marks."""
        if not text:
            return 0
        marked = BLANK + text.replace(" ", BLANK)
        if self.alone is not None:
            parts = self.alone.split(marked)
            return sum(self[s] for p in parts if p for s in self.segments.findall(p))
        return sum(map(self.__getitem__, self.segments.findall(marked)))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


_COUNTERS: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """One counter a worker process."""
    if path not in _COUNTERS:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        numbers = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        _COUNTERS[path] = MergeCounter([model.id_to_piece(i) for i in numbers], [model.get_score(i) for i in numbers])
    return _COUNTERS[path]


def count_slices(rows: DataFrame, path: str | None = None) -> DataFrame:
    """tbl, source, lang, texts array -> partial sums a batch of records, texts, chars, tokens."""
    path = path or vocabulary_path()
    schema = "tbl string, source string, lang string, records long, texts long, chars long, tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list[int]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            own = counter(path)
            for tbl, source, lang, texts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                at = sums.setdefault((tbl, source, lang), [0, 0, 0, 0])
                at[0] += 1
                for text in texts or ():
                    if text is not None:
                        at[1] += 1
                        at[2] += len(text)
                        at[3] += own.tokens(text)
            if len(sums) > 5000:
                yield _sums(sums)
                sums = {}
        if sums:
            yield _sums(sums)

    return rows.select("tbl", "source", "lang", "texts").mapInArrow(run, schema)


def _sums(sums: dict[tuple, list[int]]) -> pa.RecordBatch:
    keys = list(sums)
    columns = [pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array([sums[k][i] for k in keys], pa.int64()) for i in range(4)]
    return pa.record_batch(columns, ["tbl", "source", "lang", "records", "texts", "chars", "tokens"])


def token_budget(conversation: DataFrame, prediction: DataFrame, question: DataFrame, manifest: DataFrame, path: str | None = None) -> DataFrame:
    """tbl, source, lang, domain, records, texts, chars, tokens. A gold answer has the language of its question."""
    asked = question.where("question_id is not null").groupBy("source", "split", "question_id").agg(F.min_by("lang", "record_id").alias("lang"))
    spoken = spread(conversation.select("source", "lang", "conversations")).select(F.lit("conversation").alias("tbl"), source_key(F.col("source")).alias("source"), language(F.col("lang")).alias("lang"), F.col("conversations.value").alias("texts"))
    gold = (
        # answers without a question_id would meet in one task: each gets a key of its own that no question has
        prediction.select("source", "split", F.coalesce("question_id", F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))).alias("question_id"), "annotation")
        .join(asked, ["source", "split", "question_id"], "left")
        .select(F.lit("annotation").alias("tbl"), source_key(F.col("source")).alias("source"), language(F.col("lang")).alias("lang"), F.col("annotation").alias("texts"))
    )
    parts = count_slices(spoken.unionByName(gold), path)
    whole = parts.groupBy("tbl", "source", "lang").agg(*(F.sum(c).alias(c) for c in ("records", "texts", "chars", "tokens")))
    domains = manifest.groupBy(source_key(F.col("ds_name")).alias("source")).agg(F.max("domain").alias("domain"))
    named = (F.coalesce(F.col(c), F.lit(UNKNOWN)).alias(c) for c in ("source", "lang", "domain"))
    return whole.join(domains, "source", "left").select("tbl", *named, "records", "texts", "chars", "tokens")
