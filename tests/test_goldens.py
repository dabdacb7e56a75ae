"""Frozen boundaries: chunk counts and digests of the ends."""

import pytest

from sediment.functions.blake3 import blake3
from sediment.operators.chunkers import boundaries
from sediment.plans.formats import GOLDENS, pushed_ends
from sediment.plans.synthetic import digest


@pytest.mark.parametrize("name, profile, make, count, want", GOLDENS, ids=[g[0] for g in GOLDENS])
def test_golden(name, profile, make, count, want):
    data = make()
    for ends in (boundaries(profile, data), pushed_ends(profile, data)):
        assert (len(ends), digest(ends)) == (count, want)


@pytest.mark.parametrize("n, start", [(0, "af1349b9f5f9a1a6"), (1024, "42214739f095a406"), (1025, "d00278ae47eb27b3"), (2048, "e776b6028c7cd22a")])
def test_published_hash_vectors(n, start):
    assert blake3(bytes(i % 251 for i in range(n))).hex()[:16] == start
