"""Terms over bytes against Python's ``in``."""

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfwise.functions import byte_windows as B

TEXT = st.text(alphabet="abcé漢\x00 ", max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=6), st.lists(TEXT, min_size=1, max_size=12), st.booleans())
def test_every_term_is_found_in_every_text_that_holds_it(texts, terms, whole):
    terms = sorted(set(terms + (texts if whole else [])) - {""})
    if not terms:
        return
    size, one, two, lead = B.term_keys(pa.array(terms))
    keys = {(int(a), int(b)): t for a, b, t in zip(one, two, terms)}
    assert len(keys) == len(terms)
    block = B.TermSet(size, one, lead)
    rows, first, second = B.found(*B._buffers(pa.array(texts, pa.string())), block, block.filter())
    got = sorted((int(r), keys[(int(a), int(b))]) for r, a, b in zip(rows, first, second))
    assert got == sorted((i, t) for i, x in enumerate(texts) for t in terms if t in x)


def test_slices_of_a_batch(monkeypatch):
    monkeypatch.setattr(B, "SLICE_BYTES", 10)
    texts = ["needle", None, "x" * 100 + "needle", "", "need", "needle needle"]
    batch = pa.RecordBatch.from_pydict({"id": list(range(6)), "t": texts})
    size, one, two, lead = B.term_keys(pa.array(["needle", "a needle in a haystack"]))
    out = pa.Table.from_batches(B.scan(iter([batch]), "t", ["id"], B.TermSet(size, one, lead)))
    assert out.column("id").to_pylist() == [0, 2, 5] and set(out.column("one").to_pylist()) == {int(one.view("int64")[0])}
