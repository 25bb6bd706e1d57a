"""Why a quote was rejected: how much of it stands in its document, by a suffix automaton of the quote."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions import text as T


def longest_common(quote: str, text: str) -> int:
    """Length of the longest block that both have.

    The suffix automaton of the quote reads the text once: time grows with the two lengths, not with their product.
    """
    links, lengths, steps, last = [-1], [0], [{}], 0
    for c in quote:
        new, p = len(links), last
        links.append(0)
        lengths.append(lengths[last] + 1)
        steps.append({})
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = links[p]
        if p >= 0:
            q = steps[p][c]
            if lengths[q] == lengths[p] + 1:
                links[new] = q
            else:
                twin = len(links)
                links.append(links[q])
                lengths.append(lengths[p] + 1)
                steps.append(dict(steps[q]))
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = twin
                    p = links[p]
                links[q] = links[new] = twin
        last = new
    at = run = best = 0
    for c in text:
        while at and c not in steps[at]:
            at = links[at]
            run = lengths[at]
        if c in steps[at]:
            at = steps[at][c]
            run += 1
            best = max(best, run)
    return best


def quote_classes(rejected: DataFrame) -> DataFrame:
    """(id, longest, present, reason_class) of rejected quotes (id, quote, raw) with their documents.

    longest is the share of the quote that stands in the document's visible text in one block, present the share of its words of
    four letters and more that stand there. `near_miss` from 0.8 of the first on, else `paraphrase` from 0.6 of the second
    on, else `fabrication`. Both sides are normalised; a null or blank quote, or a null document, gives no row.
    """
    key = rejected.schema["id"].dataType.simpleString()
    schema = f"id {key}, longest double, present double, reason_class string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, out = [], []
            for i, (quote, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                words = [w for w in quote.split() if len(w) > 3]
                share = longest_common(quote, text) / len(quote)
                present = sum(w in text for w in words) / max(len(words), 1)
                kept.append(i)
                out.append((share, present, "near_miss" if share >= 0.8 else "paraphrase" if present >= 0.6 else "fabrication"))
            if kept:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), *(pa.array([x[k] for x in out], t) for k, t in ((0, pa.float64()), (1, pa.float64()), (2, pa.string())))], ["id", "longest", "present", "reason_class"])

    both = rejected.where("quote is not null and raw is not null").select("id", T.norm(F.col("quote")).alias("quote"), T.norm(T.html_to_text(F.col("raw"))).alias("raw"))
    return both.where("quote <> ''").mapInArrow(read, schema)
