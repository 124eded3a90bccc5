"""Token counts by heap-and-linked-list byte-pair merging, without making ids.

A text's symbols start as its code points. The adjacent pair whose joined piece has the lowest rank
(leftmost on ties) is merged, again and again, until no pair makes a piece; each merge takes one from
the count. Code points that are no piece count as their UTF-8 bytes.

Pieces of the vocabulary have space signs only at their start, which is checked when it is loaded, so no merge
crosses from a word into the next space, and the words of a text are counted apart and remembered.
"""

from __future__ import annotations

import gc
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SPACE = "▁"
_RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def merge_count(word: str, score: dict[str, float]) -> int:
    """Symbols left after merging, with bytes for code points that are no piece."""
    n = len(word)
    if n == 1:
        return 1 if word in score else len(word.encode("utf-8", "surrogatepass"))
    after, before, size, heap = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n, []
    for i in range(n - 1):
        if (s := score.get(word[i : i + 2])) is not None:
            heap.append((-s, i, 2))
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, span = heapq.heappop(heap)
        j = i + size[i]
        if not size[i] or j >= n or size[i] + size[j] != span:
            continue
        size[i], size[j] = span, 0
        k = after[j]
        after[i] = k
        if k < n:
            before[k] = i
            if (s := score.get(word[i : k + size[k]])) is not None:
                heapq.heappush(heap, (-s, i, span + size[k]))
        h = before[i]
        if h >= 0 and (s := score.get(word[h : i + span])) is not None:
            heapq.heappush(heap, (-s, h, size[h] + span))
        left -= 1
    i = 0
    while i < n:
        if size[i] == 1 and word[i] not in score:
            left += len(word[i].encode("utf-8", "surrogatepass")) - 1
        i = after[i]
    return left


class PieceCounter:
    def __init__(self, path: str, cached: int = 1_500_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                self.score[sp.id_to_piece(i)] = sp.get_score(i)
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError(f"{path} has pieces that run on over a space")
        if sp.encode("a b", out_type=str)[0][:1] != SPACE or sp.normalize(" ﬁ  x ") != f"{SPACE}{SPACE}ﬁ{SPACE}{SPACE}x{SPACE}":
            raise ValueError(f"{path} changes texts before it cuts them")
        self.cache: dict[str, int] = {}
        self.cached = cached

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        cache, score = self.cache, self.score
        if len(cache) > self.cached:
            cache.clear()
        text = text.replace(SPACE, " ")
        if "  " in text:
            ws = _RUNS.findall(SPACE + text.replace(" ", SPACE))
        else:
            ws = text.split(" ")
            if not ws[0] and len(ws) > 1:  # the text's own first space joins the one put before it
                ws[:2] = [SPACE + ws[1]]
            counts = list(map(cache.get, ws))
            if None in counts:
                for j, v in enumerate(counts):
                    if v is None:
                        v = merge_count(SPACE + ws[j], score)
                        if len(ws[j]) < 100:
                            cache[ws[j]] = v
                        counts[j] = v
            return sum(counts)
        total = 0
        for w in ws:
            v = cache.get(w[1:]) if w[0] == SPACE else None
            total += merge_count(w, score) if v is None else v
        return total


_counters: dict[str, PieceCounter] = {}


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row; a null text is empty and has no tokens. One narrow stage: no shuffle, each text on its own, whole.

    Ids may be null or repeat: rows are counted each. An empty table gives no rows; other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _counters:
            gc.disable()  # the cache holds no cycles
            _counters[model] = PieceCounter(model)
        count = _counters[model].count
        for keys, texts in C.rows_of(batches, "k", "t"):
            n = [count(t) for t in texts]
            yield C.batch(doc_id=pa.array(keys, pa.int64()), n_bytes=pa.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], pa.int64()), n_tokens=pa.array(n, pa.int64()), over_limit=pa.array([x > limit for x in n], pa.bool_()))

    return docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(C.documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
