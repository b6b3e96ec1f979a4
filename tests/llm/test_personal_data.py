"""Base spans against Python's own patterns; labelers, estimation and added spans on small sets."""

import hashlib
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from profilekit.llm import personal_data as pd
from profilekit.llm.common import read

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(x):
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, reversed(x)))) % 10 == 0


def brute(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TEXTS = [
    None, "", "plain", "mail a.b@c.de, x", "é 😄 a@b.co", "a@b.c+d@e.f", "a@b", "@b.c", "1.2.3.4.5.6.7.8", "1.2.3", "256.1.1.1 0255.1.1.1", "999.1.1.1.2.3.4.5",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "card 4111111111111111 and 5500 0000 0000 0004", "+1 (499) 555-6503", "+49 30 123", "+1234567890123456",
    "a" * 30_000 + "@", "1" * 30_000, "1." * 20_000, "x@" * 5000 + "y.zz", "+1 " + "(" * 5000 + "2", "a@b.c" * 300, "call 030 555-1234 0000",
]


def got(docs):
    return {r.doc_id: r for r in pd.digest(pd.find(docs)).collect()}


def check(rows, result):
    assert len(result) == len(rows)
    for d, t in rows:
        base = brute(t)
        r = result[d]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), (t or "")[:80]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in base) for k in PLAIN]
        spans = [x for x in r.spans.split(",") if x]
        assert set(base) <= set(spans)
        order = [(list(PLAIN).index(x.split(":")[0]), int(x.split(":")[1])) for x in spans]
        assert order == sorted(order)


def test_base_spans(docs_of):
    rows = list(enumerate(TEXTS))
    check(rows, got(docs_of(rows)))


def test_spans_and_surroundings(docs_of):
    """Every span's text and surroundings are those at its place; no proposal overlaps a base span of its row."""
    texts = [t or "" for t in TEXTS] + [" ".join(f"+1 (499) 555-{k % 9000 + 1000} 030 555-{k % 9000 + 1000}," for k in range(3000)), "11,22,3344 5566 7788 9900 112,é😄0305551234x 030 555 1234"]
    held = pd.materialize(pd.candidates(docs_of(list(enumerate(texts)))), "held")
    rows = pd.spans_of(held).join(held.select("row", "doc_id"), "row").collect()
    taken = {}
    for r in rows:
        t = texts[r.doc_id]
        assert r.match == t[r.start : r.end] and r.before == t[max(0, r.start - pd.CONTEXT_CHARS) : r.start].lower() and r.after == t[r.end : r.end + 1]
        if not r.proposed:
            taken.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    assert all(not taken.get(r.doc_id, set()) & set(range(r.start, r.end)) for r in rows if r.proposed)
    assert sum(r.proposed for r in rows) > 3000 and sum(not r.proposed for r in rows) > 3000


def test_many_matches_in_one_text(docs_of):
    """Cost follows the number of matches, not its square: 100,000 of them in one text end within minutes."""
    text = " ".join(f"+1 (499) 555-{k % 9000 + 1000} call 030 555-{k % 9000 + 1000}" for k in range(50_000))
    begin = time.monotonic()
    check([(1, text)], got(docs_of([(1, text)])))
    assert time.monotonic() - begin < 180


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="a1@.+- (é4", max_size=40), min_size=40, max_size=40))
def test_base_spans_on_any_text(docs_of, texts):
    rows = list(enumerate(texts))
    check(rows, got(docs_of(rows)))


def test_table_empty_and_repeats(docs_of, spark, sf):
    assert pd.digest(pd.find(docs_of([]))).count() == 0
    assert pd.digest(pd.find(docs_of([(1, "a@b.co")] * 3 + [(None, None)]))).count() == 4
    docs = read(spark, sf, "documents")
    check([tuple(r) for r in docs.select("doc_id", "text").collect()], got(docs))


def test_added_spans(docs_of):
    """Spelt-out addresses and grouped numbers beside telling words are added; order numbers are left alone."""
    rows = [(k, f"please call 0{k % 9 + 1}0 555-{1000 + k} or mail joe{k} [at] example [dot] com") for k in range(60)]
    rows += [(100 + k, f"order #{10_000_000 + 7 * k} total ${k}") for k in range(60)]
    rows += [(200 + k, f"mail x{k}@example.com, card 4111 1111 1111 1111, phone +1 (499) 555-{1000 + k}") for k in range(60)]
    result = got(docs_of(rows))
    assert all("email:" in result[k].spans and result[k].n_email == 0 for k in range(60))
    assert not any(result[100 + k].spans for k in range(60))


def test_estimate():
    """A labeler that agrees with the others is trusted; one that is silent tells nothing."""
    e = pd.estimate([((1, 1, 1, 0, 0, 0), 100), ((-1, -1, -1, 0, 0, 0), 100), ((1, 1, -1, 0, 0, 0), 5)])
    assert e[(1, 1, 1, 0, 0, 0)] > 0.95 and e[(-1, -1, -1, 0, 0, 0)] < 0.05 and e[(1, 1, -1, 0, 0, 0)] > 0.5
    assert pd.estimate([]) == {}


@pytest.mark.parametrize("number,ok", [("4111111111111111", True), ("4111111111111112", False), ("0", True), ("79927398713", True)])
def test_luhn(spark, number, ok):
    from pyspark.sql import functions as F

    assert spark.range(1).select(pd.luhn(F.lit(number))).first()[0] is ok


def test_no_python_in_plans(docs_of):
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        pd.digest(pd.find(docs_of([(1, "a@b.co")]))).explain()
    assert "Python" not in out.getvalue() and "Arrow" not in out.getvalue()
