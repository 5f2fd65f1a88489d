"""Adaptive context-mixing range coder for token ids.

Ids are cut into blocks. Each block starts from the same initial state, carries
a checksum and decodes on its own. An id's probability is a mixture of three:

* order 2: all on the id that last followed the two ids before it;
* order 1: all on the id that last followed the id before it;
* order 0: the share of each id among all ids of the call, sent beside the blocks.

The mixture's weights depend on how often either prediction has been right (its
confidence) and on whether both name the same id. They are learned within the
block: after each id a weight moves towards the share that its order had in the
probability of that id. The range coder codes the id in one step: the two
predicted ids have the first intervals, the others follow in rank order.

Blocks are coded side by side: step ``t`` codes id ``t`` of every block, so one
numpy operation serves all of them. The encoder knows all ids: it finds what
followed each context by sorting a block's contexts, and the sizes of intervals
many steps at a time, so that only the range coder itself goes step by step.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 2048
#: Blocks that are coded side by side, about: see :func:`_width`.
LANES = 4096
#: Contexts that a block keeps of each order.
_SLOTS = 1 << 11
#: Bits of a weight, and of a share of order 0.
_W, _F = 12, 18
_S = 1 << _F
_STATES = 32
#: Steps between two updates of the weights.
_TURN = 32
#: Ids after which a state's evidence counts half.
_MEMORY = 256.0
_LOW, _TOP = 32, 48
#: Blocks whose slots are sorted at a time.
_ROWS = 32


def shares(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of ``2**_F``, each at least 1; more counts than that are an error."""
    if len(counts) > _S:
        raise ValueError(f"a chunk has {len(counts)} different ids; {_S} can be coded")
    total = int(counts.sum())
    out = np.maximum(counts * _S // max(1, total), 1)
    excess = int(out.sum()) - _S
    while excess:  # taken from, or given to, the largest
        if excess < 0:
            out[0] -= excess
            break
        room = out - 1
        cut = np.minimum(room, -(-room * excess // max(1, int(room.sum()))))
        over = np.cumsum(cut)
        cut = np.where(over <= excess, cut, np.maximum(cut - (over - excess), 0))
        out -= cut
        excess = int(out.sum()) - _S
    return out


def _first_weights() -> np.ndarray:
    """Weights of order 2 and 1 by state: 16 * (different ids) + 4 * (confidence of order 2) + confidence of order 1."""
    differ, rest = np.divmod(np.arange(_STATES), 16)
    c2, c1 = np.divmod(rest, 4)
    w2 = np.array([0.0, 0.3, 0.6, 0.8])[c2]
    w1 = np.array([0.0, 0.1, 0.25, 0.4])[c1] * (1 - w2)
    return np.stack([np.where(differ, w2, w2 + w1), np.where(differ, w1, 0.0)])


#: What a slot holds beside 16 * (the id that came last): the confidence, in bits of its own for orders 2 and 1.
_CONFIDENCE, _ONE = np.array([[12], [3]], np.int32), np.array([[4], [1]], np.int32)


def _pair(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Hash of the id before and the one before that."""
    return one * 2531 + two * 709 >> 2


class _Model:
    """What the blocks that are coded side by side know; of arrays in two rows one is order 2's, one order 1's.

    Evidence of a state lies side by side for all blocks, as most use the same few states.
    """

    def __init__(self, lanes: int, share: np.ndarray) -> None:
        self.lanes, self.lane = lanes, np.arange(lanes, dtype=np.int32)
        self.none = len(share)  # stands for "no prediction"; has no share
        self.share = np.append(share, 0).astype(np.int32)
        self.below = np.append(0, np.cumsum(share)).astype(np.int32)  # [none]: all
        # evidence: ids seen, and the orders' part in them
        self.seen = np.full(lanes * _STATES, 4.0)
        self.part = 4 * np.repeat(_first_weights(), lanes, 1)
        self._weigh()

    def _weigh(self) -> None:
        top = (1 << _W) - 64  # order 0 keeps a weight of 1/64
        weights = (self.part / self.seen * top).astype(np.int32)
        self.i = (1 << _W) - weights[0] - weights[1]
        self.weights = weights << _F

    def predict(self, v: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """The two ids that slots hold, their shares, the sums of shares before them and the sizes of their intervals; order 0's weight, and where the other ids' intervals begin. ``at`` gets the states."""
        c = (v >> 4).astype(np.int64)
        f, b = self.share[c], self.below[c]
        differ = (b[0] != b[1]).astype(np.int32)
        f[1] *= differ
        state = v[0] & 12
        state += v[1] & 3
        differ <<= 4
        state += differ
        state *= self.lanes
        state += self.lane[: v.shape[-1]]
        at[...] = state
        i = self.i[at]
        e = self.weights.take(at, 1, mode="clip")
        e += i * f
        return c, f, b, e, i, e[0] + e[1]

    def learn(self, at: np.ndarray, hit: np.ndarray, size: np.ndarray) -> None:
        """Evidence of some steps: states, whether order 2 or 1 named the id, and sizes of the ids' intervals."""
        k, at, size = len(self.seen), at.reshape(-1), size.reshape(-1)
        self.seen += np.bincount(at, minlength=k)
        for part, weight, named in zip(self.part, self.weights, hit, strict=True):
            who = np.flatnonzero(named)
            state = at[who]
            part += np.bincount(state, weight[state] * (1.0 / np.maximum(size[who], 1)), k)
        full = np.flatnonzero(self.seen > _MEMORY)
        self.seen[full] *= 0.5
        self.part[:, full] *= 0.5
        self._weigh()


def _found(slot: np.ndarray, x: np.ndarray, none: int, one: int) -> np.ndarray:
    """What each id of a block (a row) finds in its slot: 16 * the id that came last + ``one`` * confidence."""
    rows, n = x.shape
    bits = n.bit_length()
    key = (slot & (_SLOTS - 1)).astype(np.int64 if bits > 20 else np.int32) << bits
    key |= np.arange(n, dtype=key.dtype)
    key.sort(axis=1)  # by slot, then step
    at = (key & ((1 << bits) - 1)) + (np.arange(rows) * n)[:, None]
    key >>= bits
    sorted_x = x.take(at)
    again = key[:, 1:] == key[:, :-1]
    last = np.full((rows, n), none, np.int32)
    np.copyto(last[:, 1:], sorted_x[:, :-1], where=again)
    hit = (last == sorted_x).view(np.int8)
    sure = again.astype(np.int32)
    sure[:, :] += hit[:, :-1]
    sure[:, 1:] += hit[:, 1:-1] & hit[:, :-2]
    last <<= 4
    last[:, 1:] += sure * again * one
    out = np.empty(rows * n, np.int32)
    out[at] = last
    return out.reshape(rows, n)


def _encode(grid: np.ndarray, last: int, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of the blocks in turn, words a block) of the ranks in ``grid`` (block, step); the last block has ``last`` ids."""
    lanes, block = grid.shape
    m = _Model(lanes, share)
    xs, found = np.empty((block, lanes), np.int32), np.empty((2, block, lanes), np.int32)
    for a in range(0, lanes, _ROWS):
        x = grid[a : a + _ROWS]
        before = np.pad(x, ((0, 0), (2, 0)))
        slot = _pair(before[:, 1:-1], before[:, :-2]), before[:, 1:-1]
        xs[:, a : a + _ROWS] = x.T
        for j in range(2):
            found[j, :, a : a + _ROWS] = _found(slot[j], x, m.none, int(_ONE[j, 0])).T
    low, rng = np.zeros(lanes, np.int64), np.full(lanes, 1 << _TOP, np.int64)
    pos = np.arange(lanes)  # where each block's next word goes
    out = np.zeros((block * 2 + 8, lanes), np.uint32)
    flat = out.reshape(-1)
    for turn in range(0, block, _TURN):
        x, v = xs[turn : turn + _TURN], found[:, turn : turn + _TURN]
        at = np.empty(x.shape, np.int64)
        _, f, b, e, i, e1 = m.predict(v, at)
        below = m.below[x]
        hit = b == below
        hit[1] &= ~hit[0]
        before = (b < below) * f
        lo = (below - before[0] - before[1]) * i + e1
        size = m.share[x] * i
        np.copyto(lo, e[0], where=hit[1])
        np.copyto(lo, 0, where=hit[0])
        for j in range(2):
            np.copyto(size, e[j], where=hit[j])
        for t in range(len(x)):
            n = lanes if turn + t < last else lanes - 1
            if not n:
                break
            if n < len(low):
                done = low[n:], pos[n:]
                low, rng, pos = low[:n], rng[:n], pos[:n]
            r = rng >> (_W + _F)
            low += r * lo[t, :n]
            np.multiply(r, size[t, :n], out=rng)
            who = np.flatnonzero(rng < 1 << _LOW)
            while len(who):
                head, place = low[who], pos[who]
                flat[place] = head >> _LOW
                low[who] = (head & ((1 << _LOW) - 1)) << 16
                pos[who] = place + lanes
                wide = rng[who] << 16
                rng[who] = wide
                who = who[wide < 1 << _LOW]
        m.learn(at, hit, size)  # what a block learns after its end has no use
    if len(low) < lanes:
        low, pos = np.concatenate([low, done[0]]), np.concatenate([pos, done[1]])
    for _ in range(3):
        flat[pos] = low >> _LOW
        low = (low & ((1 << _LOW) - 1)) << 16
        pos = pos + lanes
    pos //= lanes
    for p in range(int(pos.max()) - 1, 0, -1):  # carries, from the last word to the first
        out[p - 1] += out[p] >> 16
    words = out[: int(pos.max())].astype("<u2").T
    return words[np.arange(words.shape[1])[None, :] < pos[:, None]], pos


def _decode(stream: np.ndarray, words: np.ndarray, block: int, last: int, share: np.ndarray) -> np.ndarray:
    """The ranks (step, block) of blocks whose words lie in ``stream`` in turn."""
    lanes = len(words)
    m = _Model(lanes, share)
    rank_at = np.repeat(np.arange(m.none), share)  # by place on the line of order 0
    table = np.full(2 * _SLOTS * lanes, m.none << 4, np.int32)  # by order, slot and block, as in _found
    base = m.lane + np.array([[0], [_SLOTS * lanes]])
    pos = np.cumsum(words) - words
    code = np.zeros(lanes, np.int64)
    for _ in range(3):
        code = (code << 16) | stream.take(pos, mode="clip")
        pos += 1
    rng = np.full(lanes, 1 << _TOP, np.int64)
    grid = np.zeros((block, lanes), np.int32)
    slot, two = np.zeros((2, lanes), np.int64), np.zeros(lanes, np.int64)
    kept_at, kept_hit, kept_size = np.zeros((_TURN, lanes), np.int64), np.zeros((2, _TURN, lanes), bool), np.zeros((_TURN, lanes), np.int32)
    for t in range(block):
        n, k = lanes if t < last else lanes - 1, t % _TURN
        if not n:
            break
        if n < len(code):
            code, rng, pos, base, slot, two = code[:n], rng[:n], pos[:n], base[:, :n], slot[:, :n], two[:n]
        slot &= _SLOTS - 1
        slot *= lanes
        slot += base
        v = table[slot]
        c, f, b, e, i, e1 = m.predict(v, kept_at[k, :n])
        r = rng >> (_W + _F)
        w = (code / r).astype(np.int32)  # below 2**48 and 2**30: the quotient's floor is exact
        hit, named = kept_hit[:, k, :n], w < e1
        np.less(w, e[0], out=hit[0])
        np.greater(named, hit[0], out=hit[1])
        # the place on the line of order 0, with the predicted ids' shares put back
        w -= e1
        u = (w / i).astype(np.int32)
        put = (u >= b - (b[::-1] < b) * f[::-1]) * f
        put = put[0] + put[1]
        u += put
        x = rank_at.take(u, mode="clip")
        for j in range(2):
            np.copyto(x, c[j], where=hit[j])
        size, lo = kept_size[k, :n], m.below[x]
        lo -= put
        lo *= i
        lo += e1
        np.multiply(m.share[x], i, out=size)
        np.copyto(lo, e[0], where=hit[1])
        np.copyto(lo, 0, where=hit[0])
        for j in range(2):
            np.copyto(size, e[j], where=hit[j])
        code -= r * lo
        np.multiply(r, size, out=rng)
        who = np.flatnonzero(rng < 1 << _LOW)
        while len(who):
            place = pos[who]
            code[who] = (code[who] << 16 | stream.take(place, mode="clip")) & ((1 << 50) - 1)
            place += 1
            pos[who] = place
            wide = np.maximum(rng[who] << 16, 1)  # 0 only if damaged
            rng[who] = wide
            who = who[wide < 1 << _LOW]
        grid[t, :n] = x
        sure = np.minimum(v & _CONFIDENCE, 2 * _ONE)
        sure *= c == x
        sure += grid[t, :n] << 4
        sure += _ONE
        table[slot] = sure
        slot[0], slot[1] = _pair(x, two), x
        two = x
        if k == _TURN - 1:  # a shorter last block that is done has no use for its evidence
            m.learn(kept_at[:, :n], kept_hit[:, :, :n], kept_size[:, :n])
    return grid


def _width(blocks: int) -> int:
    """Blocks to code side by side. A step costs nearly as much for a few blocks as for many, so none are left over."""
    return -(-blocks // max(1, round(blocks / LANES)))


def _checksum(ids: np.ndarray, coded: bytes) -> int:
    """CRC-32 of a block's ids and of its coded words."""
    return zlib.crc32(coded, zlib.crc32(ids.tobytes()))


def encode(ids: np.ndarray, block: int = BLOCK) -> dict:
    """The coded blocks of ``ids`` and what decoding needs: ids by rank, their shares, blocks' sizes and checksums."""
    total = len(ids)
    none = np.zeros(0, np.uint32)
    if not total:
        return {"total": 0, "block": block, "ids": none, "shares": none, "words": none, "crc": none, "data": b""}
    seen = np.bincount(np.asarray(ids, np.int64))
    ids = np.ascontiguousarray(ids, "<u4")
    order = np.argsort(-seen, kind="stable")[: np.count_nonzero(seen)]
    rank_of = np.zeros(len(seen), np.int32)
    rank_of[order] = np.arange(len(order))
    share = shares(seen[order])
    words, sizes = [], []
    step = block * _width(-(-total // block))
    for at in range(0, total, step):
        part = ids[at : at + step]
        lanes = -(-len(part) // block)
        grid = np.zeros(lanes * block, np.int32)
        rank_of.take(part, out=grid[: len(part)], mode="clip")
        w, n = _encode(grid.reshape(lanes, block)[:, : min(block, len(part))], len(part) - (lanes - 1) * block, share)
        words.append(w)
        sizes.append(n)
    data, sizes = np.concatenate(words).tobytes(), np.concatenate(sizes)
    end = (2 * np.cumsum(sizes)).tolist()
    crc = [_checksum(ids[k * block : (k + 1) * block], data[b - 2 * n : b]) for k, (b, n) in enumerate(zip(end, sizes.tolist(), strict=True))]
    return {"total": total, "block": block, "ids": order.astype(np.uint32), "shares": share.astype(np.uint32), "words": sizes.astype(np.uint32), "crc": np.array(crc, np.uint32), "data": data}


def decode(c: dict, first: int = 0, count: int | None = None) -> np.ndarray:
    """Ids of ``count`` blocks from block ``first`` on; raises ValueError if a checksum differs."""
    block, total, words_all = c["block"], c["total"], c["words"].astype(np.int64)
    count = len(words_all) - first if count is None else count
    if not total or not count:
        return np.zeros(0, np.uint32)
    order = np.append(c["ids"], 0).astype("<u4")
    share = c["shares"].astype(np.int64)
    if len(share) != len(c["ids"]) or int(share.sum()) != _S:
        raise ValueError("shares of the ids")
    skip, out = int(words_all[:first].sum()), []
    width = _width(count)
    for a in range(first, first + count, width):
        b = min(first + count, a + width)
        words = words_all[a:b]
        n_ids = min(total, b * block) - a * block
        stream = np.append(np.frombuffer(c["data"], "<u2", int(words.sum()), 2 * skip), np.uint16(0))
        end = 2 * (skip + np.cumsum(words))
        skip += int(words.sum())
        grid = _decode(stream, words, min(block, n_ids), n_ids - (b - a - 1) * block, share)
        ids = order[grid.T.reshape(-1)[:n_ids] if b - a > 1 else grid[:n_ids, 0]]
        for k in range(b - a):
            if _checksum(ids[k * block : (k + 1) * block], c["data"][end[k] - 2 * words[k] : end[k]]) != int(c["crc"][a + k]):
                raise ValueError(f"checksum of block {a + k}")
        out.append(ids)
    return np.concatenate(out)
