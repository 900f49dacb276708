from collections import defaultdict

import pytest

from test_licenses import DOCS, WORD, lowered

from tidemark.llm import licenses


def found(words, size):
    """{label: best share} over every run of `size` words, wherever lines end."""
    best = defaultdict(float)
    for start in range(max(1, len(words) - size + 1)):
        run = set(words[start : start + size])
        for label, template in licenses.TEMPLATES:
            t = set(template.split())
            share = len(t & run) / len(t)
            if share >= licenses.THRESHOLD - 1e-12:
                best[label] = max(best[label], share)
    return best


def wrapped(text, lines, comment):
    words = text.split()
    cuts = [len(words) * i // lines for i in range(lines + 1)]
    return ("\n" + comment).join(" ".join(words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))


@pytest.mark.parametrize("lines", [2, 3])
def test_wrapped_notices(spark, lines):
    rows = []
    for i, (_, text) in enumerate(licenses.TEMPLATES):
        for place, before in enumerate((0, 20, 45, 61, 300)):
            noise = "filler\n" * before
            rows.append((i * 10 + place, f"{noise}{wrapped(text, lines, ' * ')}\n{noise}"))
    out = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame([(i, t, "s", "l") for i, t in rows], DOCS)).collect()}
    for i, text in rows:
        words = WORD.findall(lowered(text))
        sure, possible = found(words, licenses.BLOCK_WORDS // 2 + 1), found(words, licenses.BLOCK_WORDS)
        label = licenses.TEMPLATES[i // 10][0]
        assert sure[label] == 1.0
        got = set(out[i]["labels"].split(","))
        assert set(sure) <= got <= set(possible) | set(out[i]["base_labels"].split(","))
        assert out[i]["score"] == 1.0
