"""Keys of items and of shards agree at any size of the items' vocabulary."""

from consensio.llm.leaks import Items, search


def test_many_item_words():
    first = " ".join(f"alpha{i}" for i in range(30))
    rest = " ".join(f"beta{i}" for i in range(66_000))
    items = Items([("a", first), ("b", rest)])
    assert len(items.number) > 65_536
    # no word of this shard has a number beyond 16 bits
    assert search(items, [f"Before it {first} and after it"]) == [(0, "a", 2, 30)]
    assert search(items, [" ".join(f"beta{i}" for i in range(65_900, 65_940))])== [(0, "b", 0, 40)]
