"""Labels for whole columns of packets at once, where a 5-tuple's packets allow it.

Most 5-tuples never reach the odd cases of the walk: no copy of a copy, nothing after a close but a copy, no segment
before the end of the data. For these the labels are differences, first positions and running counts over columns.
:func:`label_runs` finds them and names the others, which are walked packet by packet.
"""

import numpy as np

from flowspark.contracts import ACK, DUPLICATE_WINDOW_US, FIN, RST, SYN, TCP

ACCEPTED, DUPLICATE = 0, 1


class Labels:
    """Label columns of a batch. Where ``known`` is false, from_src, gap and jitter are missing."""

    def __init__(self, n: int):
        self.flow, self.verdict, self.lost = np.zeros(n, np.int64), np.zeros(n, np.int8), np.zeros(n, np.int8)
        self.src, self.has_src = np.zeros(n, bool), np.zeros(n, bool)
        self.gap, self.has_gap = np.zeros(n, np.int64), np.zeros(n, bool)
        self.jitter, self.has_jitter = np.zeros(n, np.int64), np.zeros(n, bool)
        self.after, self.closes = np.zeros(n, bool), np.zeros(n, bool)

    def put_walked(self, begin: int, rows: list[tuple]) -> None:
        """Labels as the walk yields them, for rows from ``begin`` on."""
        at = slice(begin, begin + len(rows))
        flow, verdict, src, lost, gap, jitter, after, closes = zip(*rows)
        self.flow[at], self.verdict[at], self.lost[at], self.after[at], self.closes[at] = flow, verdict, lost, after, closes
        for values, name in ((src, "src"), (gap, "gap"), (jitter, "jitter")):
            present = np.array([v is not None for v in values])
            getattr(self, f"has_{name}")[at] = present
            getattr(self, name)[at] = [v or 0 for v in values]


def _first(size: int, group: np.ndarray, at: np.ndarray, none: int) -> np.ndarray:
    """The smallest position of each group, or ``none``."""
    out = np.full(size, none, np.int64)
    np.minimum.at(out, group, at)
    return out


def label_runs(out: Labels, offset: int, fields: dict[str, np.ndarray], now: np.ndarray | None, starts: np.ndarray,
               idle_us: int) -> np.ndarray:
    """Label rows that begin at ``starts``, each run a whole 5-tuple; returns the numbers of runs still to be walked.

    ``now`` is what idleness is judged against, the lowest number where nothing is; None stands for a packet's own time.
    """
    ts, side, flags = fields["ts_us"], fields["from_a"].astype(np.int64), fields["tcp_flags"]
    seq, length, payload = fields["tcp_seq"], fields["ip_total_len"], fields["payload_len"]
    n = len(ts)
    if idle_us < DUPLICATE_WINDOW_US:
        return np.arange(len(starts))
    fresh = np.zeros(n, bool)
    fresh[starts] = True
    run = np.cumsum(fresh) - 1
    copy = ~fresh
    copy[1:] &= ((side[1:] == side[:-1]) & (seq[1:] == seq[:-1]) & (length[1:] == length[:-1]) & (flags[1:] == flags[:-1])
                 & (ts[1:] - ts[:-1] < DUPLICATE_WINDOW_US))
    odd = np.zeros(len(starts), bool)
    odd[run[1:][copy[1:] & copy[:-1]]] = True  # a copy of a copy may be the next original

    kept = np.flatnonzero(~copy)
    place = np.arange(len(kept))
    k_ts, k_side, k_flags, k_run = ts[kept], side[kept], flags[kept], run[kept]
    begins = fresh[kept]
    judged = k_ts if now is None else now[kept]
    begins[1:] |= judged[1:] > k_ts[:-1] + idle_us
    flow = np.cumsum(begins) - 1  # numbered over all runs
    heads = np.flatnonzero(begins)
    own = flow - flow[np.flatnonzero(fresh[kept])][k_run]
    group = 2 * flow + k_side

    order = np.argsort(group, kind="stable")
    again = np.zeros(len(kept), bool)
    again[1:] = group[order][1:] == group[order][:-1]
    gap = np.zeros(len(kept), np.int64)
    gap[1:] = np.diff(k_ts[order])
    thrice = again.copy()
    thrice[1:] &= again[:-1]
    jitter = np.zeros(len(kept), np.int64)
    jitter[1:] = np.abs(gap[1:] - gap[:-1])

    tcp = fields["proto"][kept] == TCP
    none = len(kept)
    synack = np.flatnonzero(tcp & (k_flags & (SYN | ACK) == SYN | ACK))
    fin = np.flatnonzero(tcp & (k_flags & FIN > 0))
    reset = np.flatnonzero(tcp & (k_flags & RST > 0))
    flows = len(heads)
    answered = _first(2 * flows, group[synack], synack, none)
    ended = _first(2 * flows, group[fin], fin, none).reshape(flows, 2).max(axis=1)
    close = np.minimum(ended, _first(flows, flow[reset], reset, none))
    last = np.append(heads[1:], none) - 1
    odd[k_run[heads[close < last]]] = True  # packets after a close may be stragglers or reopen the slot

    sends = order[(tcp & (payload[kept] > 0))[order]]
    beyond = (seq[kept][sends] + payload[kept][sends]) & 0xFFFFFFFF
    behind = ((seq[kept][sends][1:] - beyond[:-1]) & 0xFFFFFFFF) >= 0x80000000
    odd[k_run[sends[1:][behind & (group[sends][1:] == group[sends][:-1])]]] = True

    rows = offset + kept
    out.flow[offset:offset + n] = own[np.cumsum(~copy) - 1]
    out.verdict[offset:offset + n] = np.where(copy, DUPLICATE, ACCEPTED)
    out.src[rows], out.has_src[rows] = k_side == k_side[heads][flow], True
    out.gap[rows[order]], out.has_gap[rows[order]] = gap, again
    out.jitter[rows[order]], out.has_jitter[rows[order]] = jitter, thrice
    out.after[rows] = answered[group ^ 1] < place
    out.closes[rows] = close[flow] == place
    return np.flatnonzero(odd)
