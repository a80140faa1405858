"""The registered callers read the tables' matrix that has domains, and find them."""

from collections import Counter

import pytest

from contactgrid.plans import queries
from contactgrid.sources import contacts

SF = "/root/testdata/sf0.01"
#: Bins of a domain by chromosome; each is halved, and eight lie side by side.
WIDTH = {c: contacts.DOMAIN_BINS + contacts.MORE_BINS * c for c in range(5)}
BOUNDS = {(c, k * w // 2) for c, w in WIDTH.items() for k in range(2 * contacts.DOMAINS + 1)}
INNER = {(c, k) for c, k in BOUNDS if 0 < k < contacts.DOMAINS * WIDTH[c]}
HALVES = {(c, k * w // 2, (k + 1) * w // 2) for c, w in WIDTH.items() for k in range(2 * contacts.DOMAINS)}
WHOLES = {(c, k * w, (k + 1) * w) for c, w in WIDTH.items() for k in range(contacts.DOMAINS)}


@pytest.fixture
def rows(spark, monkeypatch):
    def none(*_, **__):
        raise AssertionError("a toy matrix")

    monkeypatch.setattr(contacts, "toy_matrix", none)
    return lambda name: queries.QUERIES[name](spark, SF).collect()


def near(chrom, at):
    return any((chrom, at + k) in BOUNDS for k in (-1, 0, 1))


def test_separation(rows):
    """All boundaries but one, and no other."""
    found = {(r.chrom_id, r.start // 20_000) for r in rows("tads_separation")}
    assert found <= INNER and len(found) >= len(INNER) - 3


def test_multires(rows):
    found = {(r.chrom_id, r.start_bin, r.end_bin + 1) for r in rows("tads_multires")}
    assert found <= HALVES | WHOLES and len(found & HALVES) > 50 and len(found & WHOLES) > 5


def test_hierarchy(rows):
    found = rows("tads_hierarchy")
    inner = [r for r in found if r.level > 0]
    assert len(inner) > 40 and all(near(r.chrom_id, r.start_bin - 1) and near(r.chrom_id, r.end_bin) for r in inner)


def test_directionality_and_nests(rows):
    found = rows("tads_directionality")
    assert len(found) > 70 and sum(near(r.chrom_id, r.start // 20_000) for r in found) > 0.95 * len(found)
    found = rows("tads_nested")
    assert len(found) > 70 and sum(near(r.chrom_id, r.start // 20_000) for r in found) > 0.95 * len(found)
    assert {r.level for r in found} >= {0, 1}


def test_blocks(rows):
    found = rows("tads_blocks")
    spans = {(r.chrom_id, r.start // 20_000, r.end // 20_000 + 1) for r in found}
    assert len(found) > 30 and spans <= WHOLES | HALVES and len(spans & WHOLES) > 15


def test_alignment(rows):
    kinds = Counter(r.kind for r in rows("tads_aligned"))
    assert kinds["conserved"] > 25 and set(kinds) > {"merged"}
    levels = rows("tads_aligned_levels")
    assert levels and all(r.top_start <= r.start1 < r.end1 <= r.top_end for r in levels)


def test_weights(rows):
    assert {r.bin_id for r in rows("objective_weights")} == set(range(1370))
