"""Removal by several blocks of the benchmark gives what one block gives."""

import pytest
from cases import ordered
from test_decontaminate import ITEMS, expected, random_case

from marketpulse.llm import decontaminate

SCHEMA = "doc_id long, text string, lang string, hit string, n_chars long"


@pytest.fixture
def case():
    """Occurrences that overlap, a cut that joins a window of another item, and random ones."""
    docs, items = random_case()
    items = [(i, t) for i, t in items if i is not None]
    w = [f"z{k}" for k in range(30)]
    items += [(600 + k, " ".join(w[k : k + 10])) for k in range(0, 15, 2)]
    y = [f"y{k}" for k in range(10)]
    items += [(700, " ".join(y)), *((800 + k, " ".join(f"x{k}_{j}" for j in range(10))) for k in range(8))]
    docs += [(900, "start " + " ".join(w) + " end"), (902, None), (903, "clean, as it was "), (904, " - "), (None, " ".join(y))]
    docs += [
        (1000 + k, " ".join(["start", *y[:5], *(f"x{k}_{j}" for j in range(10)), *y[5:], "end"])) for k in range(8)
    ]
    return docs, items


def test_blocks_do_not_change_the_result(spark, monkeypatch, case):
    docs, items = case
    frame = spark.createDataFrame([(i, t, "en", "h", len(t or "")) for i, t in docs], SCHEMA)
    table = spark.createDataFrame([(*i, None) for i in items], ITEMS)
    one = decontaminate.remove(frame, table)
    assert one.columns == frame.columns
    one = ordered(one.collect())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 900)
    assert len(list(decontaminate.blocks(table, "item_id", "text"))) > 2
    several = decontaminate.remove(frame, table)
    assert several.columns == frame.columns and several.dtypes == frame.dtypes
    assert ordered(several.collect()) == one
    kept = {r[0]: r[1] for r in one}
    assert all(kept[1000 + k] == "start  end" for k in range(8))
    assert (kept[902], kept[903], kept[904]) == (None, "clean, as it was ", " - ") and None not in kept
    assert not any(r[-1] for r in expected(list(kept.items()), items))
