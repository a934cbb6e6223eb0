"""Codecs and argument checks on random values."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodestore import schema
from lodestore.functions.keys import PageToken
from lodestore.functions.routing import route_one
from lodestore.operators.predicates import delete_bounds
from lodestore.schema import InvalidArgument

KEYS = st.binary(max_size=6)


@given(KEYS, st.integers(0, 2**63 - 1), st.none() | st.integers(0, 2**32 - 1))
def test_page_tokens_come_back(key, seq, average):
    token = PageToken(key, seq, average)
    assert PageToken.decode(token.encode()) == token == PageToken.from_text(token.text())


@given(st.binary(max_size=20))
def test_bad_page_tokens_are_refused(raw):
    try:
        token = PageToken.decode(raw)
    except InvalidArgument:
        return
    assert PageToken.decode(token.encode()) == token


@given(KEYS, KEYS, st.booleans(), st.booleans(), KEYS)
def test_moved_bounds_mean_the_same_range(start, end, a, b, key):
    if start and end and start > end:
        with pytest.raises(InvalidArgument):
            delete_bounds(start, end, a, b)
        return
    low, high = delete_bounds(start, end, a, b)
    plain = (not start or (key >= start if a else key > start)) and (not end or (key <= end if b else key < end))
    assert (low <= key and (high is None or key < high)) == plain


@given(st.text(min_size=1, max_size=60), st.sampled_from([1, 2, 64, 4096]))
def test_routes_are_in_range_and_stable(record_id, n):
    for strategy in ({"kind": "simple"}, {"kind": "fnv"}, {"kind": "prefix", "length": 3}):
        p = route_one(record_id, n, strategy)
        assert 0 <= p < n and p == route_one(record_id, n, strategy)


@given(st.text(max_size=300))
def test_record_ids(record_id):
    raw = record_id.encode("utf-8", "surrogatepass")
    ok = 0 < len(raw) <= 256 and b"\0" not in raw
    if ok:
        assert schema.check_record_id(record_id) == record_id
    else:
        with pytest.raises(InvalidArgument):
            schema.check_record_id(record_id)


@given(st.none() | st.binary(max_size=20))
def test_tokens(token):
    if token is None or token == b"" or token == bytes(16):
        assert schema.check_token(token) is None
    elif len(token) == 16:
        assert schema.check_token(token) == token
    else:
        with pytest.raises(InvalidArgument):
            schema.check_token(token)


@pytest.mark.parametrize("asked, want", [(0, schema.DEFAULT_PAGE_BYTES), (None, schema.DEFAULT_PAGE_BYTES), (5, 5), (1 << 40, schema.MAX_PAGE_BYTES)])
def test_page_sizes(asked, want):
    assert schema.page_bytes(asked) == want
