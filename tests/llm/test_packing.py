import random
from array import array
from zlib import crc32

from canopy.llm import packing


def brute(docs, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    out = []
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out.append((doc_id, piece, at, len(part), crc32(array("I", part).tobytes())))
    return sorted(map(str, out))


def one_by_one(counts, capacity):
    """Sequences that best-fit decreasing uses when it places item by item."""
    free = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [k for k, f in enumerate(free) if f >= length]
            if fits:
                free[min(fits, key=free.__getitem__)] -= length
            else:
                free.append(capacity - length)
    return len(free)


def test_plan_is_gapless_and_tight():
    rng = random.Random(1)
    for _ in range(40):
        capacity = rng.choice([8, 50, 2048])
        counts = {rng.randint(1, capacity): rng.randint(1, 60) for _ in range(rng.randint(1, 40))}
        slots, used = packing.plan_slots(counts, capacity)
        places = {}
        for length, low, ranks, first, each, base in slots:
            for rank in range(ranks):
                places.setdefault(first + rank // each, []).append((base + rank % each * length, length))
        assert sum(map(len, places.values())) == sum(counts.values()) and len(places) == used
        for own in places.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= capacity
        assert used == one_by_one(counts, capacity)
        for length, n in counts.items():
            ranks = sorted((low, r) for size, low, r, *_ in slots if size == length)
            assert ranks[0][0] == 0 and sum(r for _, r in ranks) == n


def test_pieces(spark, docs_of):
    rows = [(1, "Hello, it's A B c 12 é Σίσυφος"), (2, None), (3, ""), (4, " ".join(f"w{k}" for k in range(300))), (4, "again"), (None, "x<|endoftext|>y\tz")]
    out = packing.pack(docs_of(rows).withColumnsRenamed({"lang": "length", "source": "rank"}), capacity=64).collect()
    assert sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in out) == brute(rows, 64)
    ends = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 64
    assert packing.pack(docs_of([])).count() == 0


def test_word_shortcut():
    words, rng = packing._Words(packing.default_vocabulary()), random.Random(2)
    assert words.short
    for _ in range(500):
        text = "".join(rng.choice("aB'st rééΣİ² 9\n\t\x1c\x85\xa0%&|<>") for _ in range(30))
        assert words.of_text(text) == words.encode(text)
