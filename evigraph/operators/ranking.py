"""Representative statements of a paper: relevance to what its authors stress, then diversity.

A paper's statements are ranked in one task; a paper is bounded by what its text holds.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Weights of the reference texts and priors of a statement's origin.
REFERENCE_WEIGHTS = {"abstract": 0.34, "conclusion": 0.38, "title": 0.10, "summary": 0.18}
ORIGIN_PRIOR = {"this_paper_result": 1.0, "user_curated": 0.95, "author_interpretation": 0.82, "review_synthesis": 0.58, "cited_literature_summary": 0.12}
#: Words left out of the vectors.
STOP_WORDS = frozenset("a about above after again all also an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here his how i if in into is it its itself just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your".split())


def _vectors(texts: list[str]) -> list[dict[str, float]]:
    counts = []
    for t in texts:
        w = [x for x in re.findall(r"\b\w\w+\b", t.lower()) if x not in STOP_WORDS]
        counts.append(Counter(w + [" ".join(p) for p in zip(w, w[1:], strict=False)]))
    df = Counter(t for c in counts for t in c)
    out = []
    for c in counts:
        v = {t: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in c.items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        out.append({t: x / length for t, x in v.items()} if length else {})
    return out


def _dot(a: dict[str, float], b: dict[str, float]) -> float:
    if len(a) > len(b):
        a, b = b, a
    return sum(x * b.get(t, 0.0) for t, x in a.items())


def diverse_order(base: np.ndarray, similar, keep: float = 0.85) -> list[int]:
    """Greedy order by base score less the greatest similarity to what is chosen; ties by base score, then position."""
    left, out = list(range(len(base))), []
    redundancy = np.zeros(len(base))
    while left:
        score = [(base[i] if not out else keep * base[i] - (1 - keep) * redundancy[i], base[i], -i) for i in left]
        best = left[max(range(len(left)), key=score.__getitem__)]
        out.append(best)
        left.remove(best)
        for i in left:
            redundancy[i] = max(redundancy[i], similar(i, best))
    return out


def rank_statements(statements: DataFrame) -> DataFrame:
    """(paper_id, pos, rank, score) of statements (paper_id, pos, statement, origin, n_evidence, section_evidence, rejected) with
    the paper's abstract, conclusion, title and summary; rejected and empty statements are left out."""
    kind = statements.schema["pos"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[(pdf["statement"].fillna("").str.strip() != "") & ~pdf["rejected"].fillna(False).astype(bool)].sort_values("pos")
        if pdf.empty:
            return pd.DataFrame(columns=["paper_id", "pos", "rank", "score"])
        refs = {n: t for n in REFERENCE_WEIGHTS if isinstance(t := pdf[n].iloc[0], str) and t.strip()}
        v = _vectors([*pdf["statement"], *refs.values()])
        n = len(pdf)
        total = sum(REFERENCE_WEIGHTS[r] for r in refs) or 1.0
        relevance = np.array([sum(REFERENCE_WEIGHTS[r] * _dot(v[i], v[n + k]) for k, r in enumerate(refs)) / total for i in range(n)])
        origin = np.array([ORIGIN_PRIOR.get(o, 0.65) for o in pdf["origin"]])
        support = np.minimum(1.0, np.log1p(pdf["n_evidence"].fillna(0).to_numpy(float)) / math.log(5.0))
        base = 0.68 * relevance + 0.14 * origin + 0.10 * pdf["section_evidence"].fillna(0).to_numpy(float) + 0.08 * support
        order = diverse_order(base, lambda i, j: _dot(v[i], v[j]))
        return pd.DataFrame({"paper_id": pdf["paper_id"].iloc[0], "pos": pdf["pos"].to_numpy()[order], "rank": np.arange(1, n + 1), "score": base[order].round(4)})

    return statements.groupBy("paper_id").applyInPandas(run, f"paper_id string, pos {kind}, rank int, score double")
