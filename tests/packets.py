"""Hand-written and random packets."""

import random

from flowspark.contracts import PACKET_SCHEMA

A, B = (10, 1000), (20, 80)
FIN, SYN, RST, ACK = 1, 2, 4, 16


def packet(ts, source=A, target=B, flags=ACK, seq=1, payload=0, proto=6, ttl=62, number=None, capture="c", window=255):
    header = {6: 40, 17: 28}.get(proto, 20)
    return [capture, number, ts, source[0], target[0], source[1], target[1], proto, flags if proto == 6 else 0, ttl,
            window, seq if proto == 6 else 0, payload, header + payload]


def table(spark, rows):
    numbered = [tuple(i if c == 1 and v is None else v for c, v in enumerate(r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(numbered, PACKET_SCHEMA)


def random_packets(n, kind, seed):
    rng, rows, t = random.Random(seed), [], 1_000_000
    for i in range(n):
        near = [700, 2_000, 8_000]
        far = [0, 500, 900, 4_000, 5_000, 6_000, 20_000, 3_000_000, 59_999_999, 60_000_001, 70_000_000]
        t += rng.choice([1_000, 1_300, 1_700]) if kind == "flood" else rng.choice(far if rng.random() < 0.5 else near)
        ends = (A, B) if kind == "flood" or rng.random() < 0.6 else (B, A)
        if kind in ("udp", "flood"):
            payload = rng.choice([10, 20]) if kind == "udp" else 10
            rows.append(packet(t, *ends, payload=payload, proto=17))
        elif kind == "bulk":
            seq = (4_294_000_000 + i * 1_000 - rng.choice([0, 0, 0, 3_000, 1_500])) % 2**32
            rows.append(packet(t, *ends, seq=seq, payload=1_000))
        else:
            flags = rng.choice([2, 18, 16, 16, 16, 17, 4, 6, 3, 24])
            rows.append(packet(t, *ends, flags, rng.choice([100, 200, 300, 4_294_967_000]), rng.choice([0, 50, 100])))
    return rows
