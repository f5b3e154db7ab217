"""Token-sort similarity (M1, M2) as column expressions.

M1 ("indel" ratio) = 2*LCS(a, b) / (len a + len b) on the T2 keys, scaled
to 0..100 with half-even rounding.  LCS is computed with the bit-parallel
recurrence (one machine word per 62 pattern characters):

    V = all ones;  for each char c of the question:  U = V & M[c]
                                                     V = (V + U) | (V & ~M[c])
    LCS = number of zero bits of V

The per-pattern bitmasks ``M`` are built once per distinct pattern key and
broadcast with the pattern table, so each (question, pattern) pair costs one
fold over the question's characters, with no array copies.  The carry of
the word addition is propagated across words; 62-bit words keep every sum
below 2**63, so ANSI overflow checks never fire.

M2 is the reference-parity ratio (Ratcliff/Obershelp: the longest common block, and
again on both sides of it), a fold over a stack of segments; it is only applied
to pairs that M1 lets through, because M1 >= M2 for every pair.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

WORD_BITS = 62
FULL_WORD = (1 << WORD_BITS) - 1

# The expressions below are Spark SQL text, parsed once by ``F.expr``: the
# same trees built through the Column API take hundreds of driver round
# trips.  Arguments are column names (or SQL expressions).  A value used
# inside a lambda is bound once with a one-element ``transform`` ("let"),
# because an expression referenced inside a lambda is re-evaluated per
# element.


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sql_let(value: str, var: str, body: str) -> str:
    return f"element_at(transform(array({value}), {var} -> {body}), 1)"


def chars_sql(s: str) -> str:
    return f"IF({s} = '', CAST(array() AS array<string>), split({s}, ''))"


def chars_of(s: str) -> Column:
    """Characters of a string as an array (empty string -> empty array)."""
    return F.expr(chars_sql(s))


def char_bag_sql(s: str) -> str:
    counts = "transform(fs, (p, i) -> CAST(coalesce(try_element_at(fs, i + 2), size(srt) + 1) - p AS INT))"
    firsts = "transform(array_distinct(srt), ch -> array_position(srt, ch))"
    body = f"map_from_arrays(array_distinct(srt), {_sql_let(firsts, 'fs', counts)})"
    return _sql_let(f"sort_array({chars_sql(s)})", "srt", body)


def char_bag(s: str) -> Column:
    """map<char, count> of a string: characters sorted once, each distinct
    character's count is the gap between its first position and the next
    distinct character's (native ``array_position``, no per-comparison
    lambda)."""
    return F.expr(char_bag_sql(s))


def pattern_bitmasks(key: str) -> tuple[Column, Column, Column]:
    """(word count, char -> array<bigint> position masks, initial V words)."""
    n = f"length({key})"
    nw = f"greatest(1, CAST(ceil({n} / {WORD_BITS}) AS INT))"
    hi = f"(least({n}, (w + 1) * {WORD_BITS}) - 1)"
    word_mask = (f"aggregate(filter(sequence(w * {WORD_BITS}, greatest(w * {WORD_BITS}, {hi})), j -> j <= {hi}), "
                 f"0L, (acc, j) -> acc | IF(substring({key}, j + 1, 1) = ch, shiftleft(1L, j - w * {WORD_BITS}), 0L))")
    masks_body = f"map_from_arrays(dc, transform(dc, ch -> transform(sequence(0, {nw} - 1), w -> {word_mask})))"
    masks = _sql_let(f"array_distinct({chars_sql(key)})", "dc", masks_body)
    init = (f"transform(sequence(0, {nw} - 1), w -> IF(w = {nw} - 1, "
            f"shiftleft(1L, {n} - w * {WORD_BITS}) - 1, {FULL_WORD}L))")
    return F.expr(nw), F.expr(masks), F.expr(init)


def lcs_sql(q_chars: str, p_len: str, p_nw: str, p_masks: str, p_init: str) -> str:
    full = f"{FULL_WORD}L"
    m1 = f"coalesce(element_at(try_element_at({p_masks}, ch), 1), 0L)"
    # single-word fast path: a bigint accumulator, no arrays
    v1 = f"aggregate({q_chars}, element_at({p_init}, 1), (v, ch) -> ((v + (v & {m1})) & {full}) | (v & ~{m1}))"
    lcs1 = f"({p_len} - bit_count({v1} & (shiftleft(1L, {p_len}) - 1)))"
    # general path: words with carry propagation
    mw = f"element_at(coalesce(try_element_at({p_masks}, ch), array_repeat(0L, {p_nw})), w + 1)"
    vw = "element_at(vw, w + 1)"
    sm = f"({vw} + ({vw} & {mw}) + acc.carry)"
    wstep = (f"named_struct('carry', shiftright({sm}, {WORD_BITS}), "
             f"'out', concat(acc.out, array(({sm} & {full}) | ({vw} & ~{mw}))))")
    stepn = (f"aggregate(sequence(0, {p_nw} - 1), named_struct('carry', 0L, 'out', CAST(array() AS array<bigint>)), "
             f"(acc, w) -> {wstep}).out")
    vn = f"aggregate({q_chars}, {p_init}, (vw, ch) -> {stepn})"
    last_bits = f"({p_len} - ({p_nw} - 1) * {WORD_BITS})"
    zeros = (f"aggregate(sequence(0, {p_nw} - 1), 0, (acc, w) -> acc + IF(w = {p_nw} - 1, "
             f"bit_count(element_at(vn, w + 1) & (shiftleft(1L, {last_bits}) - 1)), bit_count(element_at(vn, w + 1))))")
    lcsn = f"({p_len} - {_sql_let(vn, 'vn', zeros)})"
    return f"IF({p_nw} = 1, {lcs1}, {lcsn})"


def lcs_length(q_chars: str, p_len: str, p_nw: str, p_masks: str, p_init: str) -> Column:
    """LCS of the question characters against a pattern's bitmasks."""
    return F.expr(lcs_sql(q_chars, p_len, p_nw, p_masks, p_init))


def ratio_sql(m: str, t: str) -> str:
    return f"CAST(bround(100.0D * ((2.0D * CAST({m} AS DOUBLE)) / CAST({t} AS DOUBLE)), 0) AS INT)"


def ratio_from_matches(matches, total) -> Column:
    """int(round(100 * (2.0 * M / T))) with Python's half-even rounding."""
    r = (F.lit(2.0) * _c(matches).cast("double")) / _c(total).cast("double")
    return F.bround(F.lit(100.0) * r, 0).cast("int")


def indel_score(q_key, q_len, q_chars, p_key, p_len, p_nw, p_masks, p_init) -> Column:
    """M1 on precomputed key columns, with the matcher's edge cases:
    equal keys -> 100 (also both empty), one key empty -> 0."""
    lcs = lcs_sql(q_chars, p_len, p_nw, p_masks, p_init)
    return F.expr(f"CASE WHEN {q_key} = {p_key} THEN 100 WHEN {q_len} = 0 OR {p_len} = 0 THEN 0 "
                  f"ELSE {ratio_sql(lcs, f'{q_len} + {p_len}')} END")


def length_bound(q_len: str, p_len: str) -> Column:
    """Upper bound of M1 from lengths alone (LCS <= min length)."""
    return F.expr(ratio_sql(f"least({q_len}, {p_len})", f"{q_len} + {p_len}"))


def bag_common_sql(q_bag: str, p_bag: str) -> str:
    return (f"aggregate(map_entries({q_bag}), 0, (acc, e) -> acc + "
            f"least(e.value, coalesce(try_element_at({p_bag}, e.key), 0)))")


def bag_common(q_bag: str, p_bag: str) -> Column:
    """Size of the multiset intersection of two character bags (>= LCS)."""
    return F.expr(bag_common_sql(q_bag, p_bag))


def bag_bound(q_bag: str, q_len: str, p_bag: str, p_len: str) -> Column:
    return F.expr(ratio_sql(bag_common_sql(q_bag, p_bag), f"{q_len} + {p_len}"))


# ------------------------------------------------- M1 for a block of patterns

# Patterns and keys that are compared at once, and what the masks of so many patterns may take.
BLOCK_PATTERNS, BLOCK_KEYS, BLOCK_BYTES = 512, 64, 64 << 20


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the length of each."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return flat, np.array([len(t) for t in texts], dtype=np.int64)


def _lcs_block(keys: list[str], patterns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """LCS of every key with every pattern by the recurrence above; lengths of keys and patterns."""
    flat, plen = _codes(patterns)
    chars, at = np.unique(flat, return_inverse=True)
    n_words = max(1, -(-int(plen.max(initial=0)) // WORD_BITS))
    starts = np.cumsum(plen) - plen
    place = np.arange(len(flat)) - np.repeat(starts, plen)
    bit = np.left_shift(np.uint64(1), (place % WORD_BITS).astype(np.uint64))
    masks = np.zeros((n_words, len(chars) + 1, len(patterns)), dtype=np.uint64)      # the last character: none
    np.bitwise_or.at(masks, (place // WORD_BITS, at, np.repeat(np.arange(len(patterns)), plen)), bit)
    init = np.bitwise_or.reduce(masks, axis=1)
    kflat, klen = _codes(keys)
    code = np.full((len(keys), int(klen.max(initial=0))), len(chars), dtype=np.int64)
    if len(chars) and len(kflat):
        near = np.minimum(np.searchsorted(chars, kflat), len(chars) - 1)
        code[np.arange(code.shape[1]) < klen[:, None]] = np.where(chars[near] == kflat, near, len(chars))
    full, top = np.uint64(FULL_WORD), np.uint64(WORD_BITS)
    v = [np.repeat(w[None, :], len(keys), axis=0) for w in init]
    for j in range(code.shape[1]):
        carry = None
        for w in range(n_words):
            m = masks[w][code[:, j]]
            u = v[w] & m
            total = v[w] + u
            if carry is not None:
                total += carry
            if w + 1 < n_words:
                carry = total >> top
            v[w] = (total & full) | (v[w] ^ u)
    left = sum(np.bitwise_count(x & i).astype(np.int64) for x, i in zip(v, init))
    return plen[None, :] - left, klen, plen


def first_passing(keys: list[str | None], patterns: list[str], threshold: int) -> np.ndarray:
    """Per key the place of the first pattern that M1 lets through at ``threshold``, -1 without one.

    Blocks of patterns are tried in turn, and only keys that none has let through go on."""
    out = np.full(len(keys), -1, dtype=np.int64)
    order = sorted((i for i, k in enumerate(keys) if k is not None), key=lambda i: len(keys[i]))
    lo = 0
    while lo < len(patterns) and order:
        n = BLOCK_PATTERNS if lo else BLOCK_PATTERNS // 8
        part = patterns[lo:lo + n]
        while len(part) > 1 and 8 * len(part) * len(set().union(*part)) * (max(map(len, part)) // WORD_BITS + 1) > BLOCK_BYTES:
            part = part[:len(part) // 2]
        for k in range(0, len(order), BLOCK_KEYS):
            some = order[k:k + BLOCK_KEYS]
            lcs, klen, plen = _lcs_block([keys[i] for i in some], part)
            a, b = klen[:, None], plen[None, :]
            score = np.rint(100.0 * ((2.0 * lcs) / np.maximum(a + b, 1)))
            hit = (a == b) & (lcs == a) | (a > 0) & (b > 0) & (score >= int(threshold))
            found = np.where(hit.any(axis=1), lo + hit.argmax(axis=1), -1)
            out[some] = found
        lo += len(part)
        order = [i for i in order if out[i] < 0]
    return out


# ---------------------------------------------------------------- M2 (exact)

def _matched_sql(a: str, b: str) -> str:
    """Characters in the matching blocks of two strings of length > 0.

    The longest block that both have (the first in ``a``, then in ``b``, of equal ones), and
    the same again on what lies before it and behind it in both; the segments that are still to be
    looked at are kept in a stack.  Characters that are popular in a long ``b`` begin
    no block, but a block grows over them on both sides.
    """
    popular = "IF(size(bs) < 200, CAST(array() AS array<string>), filter(array_distinct(bs), c -> size(filter(bs, x -> x = c)) > size(bs) div 100 + 1))"
    seg = "named_struct('al', {}, 'ah', {}, 'bl', {}, 'bh', {})".format
    # one row of block lengths per character of the segment of a: a block goes on from the place before
    row = ("transform(slice(bn, g.bl + 1, g.bh - g.bl), (c, y) -> IF(c = element_at(as, i + 1), "
           "IF(y = 0, 0, element_at(t.row, y)) + 1, 0))")
    better = "named_struct('k', mx, 'i', i - mx + 1, 'j', CAST(g.bl + array_position(r, mx) - mx AS INT), 'row', r)"
    keep = "named_struct('k', t.k, 'i', t.i, 'j', t.j, 'row', r)"
    longest = (f"aggregate(sequence(g.al, g.ah - 1), named_struct('k', 0, 'i', g.al, 'j', g.bl, 'row', array_repeat(0, g.bh - g.bl)), "
               f"(t, i) -> {_sql_let(row, 'r', _sql_let('array_max(r)', 'mx', f'IF(mx > t.k, {better}, {keep})'))})")

    def run(count, differ):         # how many of the next ``count`` places agree
        return _sql_let(count, "w", f"coalesce(try_element_at(filter(sequence(1, greatest(1, w)), x -> x <= w AND {differ}), 1) - 1, w)")

    left = run("least(h.i - g.al, h.j - g.bl)", "element_at(as, h.i - x + 1) <> element_at(bs, h.j - x + 1)")
    right = run("least(g.ah - h.i - h.k, g.bh - h.j - h.k)", "element_at(as, h.i + h.k + x) <> element_at(bs, h.j + h.k + x)")
    wider = _sql_let(left, "l", _sql_let(right, "q", "named_struct('k', h.k + l + q, 'i', h.i - l, 'j', h.j - l)"))
    grown = f"IF(size(ps) = 0, named_struct('k', h.k, 'i', h.i, 'j', h.j), {wider})"
    before = f"IF(m.i > g.al AND m.j > g.bl, array({seg('g.al', 'm.i', 'g.bl', 'm.j')}), {{none}})"
    after = f"IF(m.i + m.k < g.ah AND m.j + m.k < g.bh, array({seg('m.i + m.k', 'g.ah', 'm.j + m.k', 'g.bh')}), {{none}})"
    none = f"filter(array({seg('0', '0', '0', '0')}), z -> false)"
    left_over = f"concat(slice(s.todo, 1, size(s.todo) - 1), {before.format(none=none)}, {after.format(none=none)})"
    found = f"IF(m.k = 0, named_struct('n', s.n, 'todo', slice(s.todo, 1, size(s.todo) - 1)), named_struct('n', s.n + m.k, 'todo', {left_over}))"
    step = _sql_let("element_at(s.todo, -1)", "g", _sql_let(longest, "h", _sql_let(grown, "m", found)))
    start = f"named_struct('n', 0, 'todo', array({seg('0', 'size(as)', '0', 'size(bs)')}))"
    fold = f"aggregate(sequence(1, 2 * least(size(as), size(bs)) + 1), {start}, (s, u) -> IF(size(s.todo) = 0, s, {step})).n"
    body = _sql_let(popular, "ps", _sql_let("transform(bs, c -> IF(array_contains(ps, c), '', c))", "bn", fold))
    return _sql_let(chars_sql(a), "as", _sql_let(chars_sql(b), "bs", body))


def exact_score(p_key: str, q_key: str) -> Column:
    """M2 of two prepared keys (column names): argument order matters, the matcher is asymmetric."""
    ratio = ratio_sql(_matched_sql(p_key, q_key), f"length({p_key}) + length({q_key})")
    return F.expr(f"CASE WHEN {p_key} IS NULL OR {q_key} IS NULL THEN NULL WHEN {p_key} = {q_key} THEN 100 "
                  f"WHEN {p_key} = '' OR {q_key} = '' THEN 0 ELSE {ratio} END")
