import re

import pytest

from tidemark.llm import common, exact_dedup
from tidemark.llm.common import batch_by_batch, give_back


def resident() -> int:
    """MB of this process that are no files'."""
    with open("/proc/self/status") as status:
        return int(re.search(r"RssAnon:\s+(\d+)", status.read())[1]) // 1024


def test_free_memory_goes_back_to_the_system():
    kept, held = [], []
    for i in range(300_000):  # every hundredth block stays, so the free ones between lie scattered
        (kept if i % 100 == 0 else held).append(bytes(1000))
    full = resident()
    held.clear()
    give_back()
    assert len(kept) == 3000 and full - resident() > 200


def test_a_task_gives_memory_back_at_its_end(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    assert list(batch_by_batch(iter([1, 2, 3]), lambda x: x + 1)) == [2, 3, 4] and len(calls) == 1
    early = batch_by_batch(iter([1, 2, 3]), lambda x: x + 1)
    next(early)
    early.close()
    assert len(calls) == 2
    with pytest.raises(ZeroDivisionError):
        list(batch_by_batch(iter([1, 0]), lambda x: 1 / x))
    assert len(calls) == 3


def test_state_is_bounded_outside_the_heap(spark, monkeypatch):
    """RocksDB's memory is one bound for an executor, not one for each partition."""
    seen, plain = [], exact_dedup.setting
    monkeypatch.setattr(exact_dedup, "setting", lambda s, **conf: seen.append(conf) or plain(s, **conf))
    docs = spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, None)], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in exact_dedup.keep_first(docs).collect()) == [1, 3]
    conf = {k.rpartition("__")[2]: v for k, v in seen[0].items()}
    assert conf["boundedMemoryUsage"] == "true" and int(conf["maxMemoryUsageMB"]) <= 100
