"""Scoring texts with a classifier supplied by the user, as a distributed batch job."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame

Scorer = Callable[[pd.Series], Sequence[str | None]]
Answer = tuple[str | None, str | None]

#: Characters a batch has at most once all its texts are as long as its longest, and texts it has at most.
BATCH_CHARS, BATCH_TEXTS = 1 << 18, 256
#: Batches' worth of texts that a task sorts by length at a time.
POOL = 16


def cut_batches(lengths: np.ndarray, chars: int = BATCH_CHARS, texts: int = BATCH_TEXTS) -> Iterator[np.ndarray]:
    """Places of texts, batch by batch, longest first: neighbours in length share a batch, so little of it is padding.

    A text longer than ``chars`` is a batch of its own.
    """
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        n = min(texts, max(1, chars // max(1, int(lengths[order[at]]))))
        yield order[at:at + n]
        at += n


def score_all(scorer: Scorer, texts: pd.Series) -> list[Answer]:
    """Answer and status of each text. A batch that fails is tried in halves, down to the texts that fail alone."""
    try:
        answers = list(scorer(texts))
        if len(answers) != len(texts):
            raise ValueError("a scorer answers each text")
        return [(a, None) if a else (None, "empty_response") for a in answers]
    except Exception as err:  # noqa: BLE001 - reported per text
        if len(texts) == 1:
            return [(None, "timeout" if isinstance(err, TimeoutError) else "error")]
        half = len(texts) // 2
        return score_all(scorer, texts.iloc[:half]) + score_all(scorer, texts.iloc[half:])


def _pools(batches: Iterable[pd.DataFrame], text: str, chars: int, texts: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    held: list[pd.DataFrame] = []
    sizes: list[np.ndarray] = []
    for pdf in batches:
        held.append(pdf)
        sizes.append(pdf[text].map(lambda v: len(v) if isinstance(v, str) else 0).to_numpy(dtype=np.int64))
        if sum(map(len, sizes)) >= POOL * texts or sum(int(s.sum()) for s in sizes) >= POOL * chars:
            yield pd.concat(held, ignore_index=True), np.concatenate(sizes)
            held, sizes = [], []
    if held:
        yield pd.concat(held, ignore_index=True), np.concatenate(sizes)


def score_text(df: DataFrame, keys: Sequence[str], text: str, make_scorer: Callable[[], Scorer], *, batch_chars: int = BATCH_CHARS,
               batch_texts: int = BATCH_TEXTS, report: bool = False, profile: ResourceProfile | None = None) -> DataFrame:
    """Adds ``response`` and ``status`` (null, ``timeout``, ``empty_response`` or ``error``) to each text.

    ``make_scorer`` runs once per task, so a model is loaded once and used for every batch. A task sorts what it reads by
    length, pool by pool, and cuts batches by the size they have when padded. A failing text gets a status instead of failing
    the job. A scorer gets a null text as it is. ``report`` adds ``batch_longest``, the length each text of a batch is padded to:
    the share of padding is one less the sum of lengths by that of ``batch_longest``. ``profile`` names what a task of this
    step needs (an accelerator, more memory), apart from the rest of the job.
    """
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    ddl = ", ".join(f"`{k}` {fields[k]}" for k in keys) + ", response string, status string" + (", batch_longest bigint" if report else "")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for pool, lengths in _pools(batches, text, batch_chars, batch_texts):
            for places in cut_batches(lengths, batch_chars, batch_texts):
                rows = pool.iloc[places]
                answers = score_all(scorer, rows[text].reset_index(drop=True))
                out = rows[list(keys)].reset_index(drop=True)
                out["response"] = [a for a, _ in answers]
                out["status"] = [s for _, s in answers]
                if report:
                    out["batch_longest"] = int(lengths[places[0]])
                yield out

    return df.select(*dict.fromkeys([*keys, text])).mapInPandas(run, ddl, profile=profile)


def pending(df: DataFrame, blocked: DataFrame, key: str) -> DataFrame:
    """Texts an earlier, cheaper filter has not blocked yet; only these need an expensive scorer."""
    return df.join(blocked.select(key).distinct(), key, "left_anti")
