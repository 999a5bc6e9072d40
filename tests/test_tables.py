"""Which stored tables stay."""

from pathlib import Path

from cellcnv.functions.tables import passing, stored


def test_only_kept_tables_stay(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    there = lambda what: len(list(folder.glob(f"{what}-*")))
    free = stored(spark.range(3), "free")
    with passing(spark) as kept:
        gone = stored(free, "gone")
        with passing(spark) as held:
            once = stored(gone, "once")
            inner = held(once.where("id > 0"), "inner")
        assert there("once") == 0 and there("inner") == 1 and inner.count() == 2
        out = kept(inner.where("id > 1"), "out")
    assert [there(w) for w in ("free", "gone", "inner", "out")] == [1, 0, 0, 1] and out.count() == 1
    try:
        with passing(spark):
            stored(free, "failed")
            raise KeyError
    except KeyError:
        assert there("failed") == 0
