"""Token counts without token ids.

A byte-level BPE encodes each pre-token by itself, so a document's count is the sum, over its distinct
pre-tokens, of times times pieces. Blocks of documents give postings of pre-tokens; these are dealt by
pre-token, each partition asks the library once for each distinct pre-token it holds, and adds to the
documents that hold it. Only sums per document go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import corpus
from matchlens.llm.postings import BLOCK_BITS, DOCUMENT, PARTIAL, PLACE_BITS, SlotSums, postings, totals
from matchlens.llm.pretokens import piece_memo, split, vocabulary_path

#: Bits of a block's number that deal its postings beside the pre-token: those of one pre-token go to
#: a partition of its own for every 4096 input tasks, not all to one.
GROUP_BITS = BLOCK_BITS + 12
SUMS = f"{PARTIAL}, {DOCUMENT}"
_ARROW = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = 1024) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row.

    A null or empty text has no bytes and no tokens. Repeated rows are counted each; an empty table
    gives no rows. A text whose pre-tokens cannot be told apart here (an added token's string, a code
    point newer than this Python) is counted by the library whole.
    """
    vocabulary = vocabulary or vocabulary_path()

    def splitter():
        memo = piece_memo(vocabulary)

        def terms(texts: list[str]):
            for text in texts:
                pieces = None if memo.special(text) else split(text)
                yield ([], len(memo.encode([text])[0])) if pieces is None else (pieces, 0)

        return terms

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = piece_memo(vocabulary)
        sums = SlotSums(1)
        kinds = pa.schema([(c, _ARROW[k]) for c, k in (x.split() for x in SUMS.split(", "))])

        def row(given: pa.RecordBatch) -> pa.RecordBatch:
            n = given.num_rows
            return pa.RecordBatch.from_arrays([given.column(f.name) if f.name in given.schema.names else pa.nulls(n, f.type) for f in kinds], schema=kinds)

        last, pieces_of_last = None, 0
        for b in batches:
            c = dict(zip(b.schema.names, b.columns))
            known = c["slot"].is_valid()
            if known.true_count:
                own = b.filter(known)
                block = pa.array(own.column("slot").to_numpy() >> PLACE_BITS)
                yield row(own.set_column(own.schema.get_field_index("block"), "block", block))
                b = b.filter(c["slot"].is_null())
                c = dict(zip(b.schema.names, b.columns))
            terms = c["term"].to_pylist()
            if not terms:
                continue
            # Sorted by term: each distinct one is asked for once, over the bounds of batches too.
            at = [i for i, t in enumerate(terms) if i == 0 or t != terms[i - 1]]
            asked = [terms[i] for i in at]
            skip = int(asked[0] == last)
            found = memo.counts([t.decode() for t in asked[skip:]])
            found = [pieces_of_last] * skip + found
            last, pieces_of_last = asked[-1], found[-1]
            n = np.repeat(np.asarray(found, np.int64), np.diff([*at, len(terms)]))
            sums.add(c["block"].to_numpy(), c["places"], c["times"], n)
            if sums.full():
                yield row(sums.take())
        yield row(sums.take())

    by_term = F.xxhash64("term", F.shiftright("block", GROUP_BITS))
    key = F.when(F.col("term").isNull(), F.xxhash64("slot")).otherwise(by_term)
    dealt = postings(corpus(docs), splitter).repartition(key).sortWithinPartitions("term")
    counted = totals(dealt.mapInArrow(count, SUMS), 1)
    n_tokens = (F.col("sum0") + F.col("value")).cast("long")
    return counted.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
