"""Plain SQL that recomputes the queries' answers on another engine, for checking only.

The packet walk is a recursive query here, and gaps, jitter and handshakes are window functions, so the
checked side shares neither method nor code with the Spark side.
"""

from flowspark.contracts import FLOW_COLUMNS, HISTORY_COUNTS
from flowspark.sources import views

PACKETS = views.PACKETS_SQL.replace("{copies}", ", (values (0), (1)) d(dup)")
DETECTIONS = views.DETECTIONS_SQL.replace("{micros}", "epoch_us(ts)")
SCORES = views.SCORES_SQL
LABELLED = views.LABELLED_SQL


def walk_ctes(idle_us: int | None = 60_000_000, every: int | None = None, packets: str = PACKETS) -> str:
    """CTEs ``numbered`` (packets by 5-tuple) and ``labelled`` (with flow, verdict, loss and close).

    With ``every``, idleness is looked at once per so many packets of a capture only.
    """
    expired = "false" if idle_us is None else f"p.{'ts_us' if every is None else 'now_us'} > w.acc + {idle_us}"
    clock = "cast(null as bigint)" if every is None else (
        f"max(case when place % {every} = 0 then ts_us end) over (partition by capture_id order by place)")
    return f"""
numbered as materialized (
  select *, {clock} now_us, dense_rank() over (order by capture_id, ip_a, port_a, ip_b, port_b, proto) kid,
    row_number() over (partition by capture_id, ip_a, port_a, ip_b, port_b, proto order by ts_us, pkt_no) rn
  from (
    select *, row_number() over (partition by capture_id order by ts_us, pkt_no) place,
      case when a then src_ip else dst_ip end ip_a, case when a then src_port else dst_port end port_a,
      case when a then dst_ip else src_ip end ip_b, case when a then dst_port else src_port end port_b
    from (select *, src_ip < dst_ip or (src_ip = dst_ip and src_port <= dst_port) a from ({packets}) p0) p1
  ) p2),
walked as (
  select distinct kid, cast(0 as bigint) rn, 0 phase, cast(-1 as bigint) flow, 0 fins, cast(0 as bigint) acc,
    false s_a, cast(0 as bigint) s_seq, cast(0 as bigint) s_len, 0 s_flags, cast(-1 as bigint) s_ts,
    cast(-1 as bigint) top_a, cast(-1 as bigint) top_b, 0 verdict, false lost, false closes
  from numbered
  union all
  select kid, rn, case when verdict > 0 then ph when closes then 2 else 1 end, flow, fins,
    case when verdict = 0 then ts_us else acc end,
    case when verdict = 1 then s_a else a end, case when verdict = 1 then s_seq else tcp_seq end,
    case when verdict = 1 then s_len else ip_total_len end, case when verdict = 1 then s_flags else tcp_flags end,
    case when verdict = 1 then s_ts when reopen then -1 else ts_us end,
    case when moves and a then (tcp_seq + payload_len) % 4294967296 else top_a end,
    case when moves and not a then (tcp_seq + payload_len) % 4294967296 else top_b end,
    verdict, lost, closes
  from (
    select *, data and not lost moves,
      verdict = 0 and proto = 6 and ((tcp_flags // 4) % 2 = 1 or fins = 3) closes
    from (
      select * exclude (fins, top_a, top_b, flow),
        flow + case when fresh then 1 else 0 end flow,
        case when verdict > 0 then fins
             when proto = 6 and tcp_flags % 2 = 1
               then (case when fresh then 0 else fins end) | (case when a then 2 else 1 end)
             when fresh then 0 else fins end fins,
        case when fresh then -1 else top_a end top_a, case when fresh then -1 else top_b end top_b,
        verdict = 0 and proto = 6 and payload_len > 0 data,
        verdict = 0 and proto = 6 and payload_len > 0 and not fresh
          and (case when a then top_a else top_b end) >= 0
          and (tcp_seq - (case when a then top_a else top_b end) + 4294967296) % 4294967296 >= 2147483648 lost
      from (
        select *, not dup and ph = 2 and pure_syn reopen,
          not dup and (ph = 0 or (ph = 2 and pure_syn)) fresh,
          case when dup then 1 when ph = 2 and not pure_syn then 2 else 0 end verdict
        from (
          select *, ph > 0 and s_ts >= 0 and a = s_a and tcp_seq = s_seq and ip_total_len = s_len
              and tcp_flags = s_flags and ts_us - s_ts < 5000 dup
          from (
            select p.kid, p.rn, p.ts_us, p.a, p.proto, p.tcp_flags, p.tcp_seq, p.ip_total_len, p.payload_len,
              w.flow, w.fins, w.acc, w.s_a, w.s_seq, w.s_len, w.s_flags, w.s_ts, w.top_a, w.top_b,
              case when w.phase > 0 and {expired} then 0 else w.phase end ph,
              (p.tcp_flags // 2) % 2 = 1 and (p.tcp_flags // 16) % 2 = 0 pure_syn
            from walked w join numbered p on p.kid = w.kid and p.rn = w.rn + 1
          ) x0) x1) x2) x3) x4),
labelled as materialized (
  select n.*, w.flow flow_seq, w.verdict, w.lost, w.closes
  from numbered n join walked w on n.kid = w.kid and n.rn = w.rn)"""


def flow_ctes(idle_us: int | None = 60_000_000, every: int | None = None, packets: str = PACKETS) -> str:
    """CTEs up to ``flows``: every flow's endpoints, measures, labels and emission number."""
    emit = "ltime_us + 60000000" if idle_us is not None else "4611686018427387904"
    if every is not None:
        emit = (f"coalesce((select min(now_us) from sweeps w where w.capture_id = summed.capture_id "
                f"and w.now_us > summed.ltime_us + {idle_us}), 4611686018427387904)")
    ratio = lambda a, b: f"case when {b} > 0 then {a} / cast({b} as double) else 0.0 end"
    return walk_ctes(idle_us, every, packets) + f""",
sweeps as materialized (select distinct capture_id, now_us from numbered where now_us is not null),
accepted as materialized (
  select *, lag(ts_us) over (partition by kid, flow_seq, s order by rn) before,
    row_number() over (partition by kid, flow_seq, s order by rn) nth
  from (
    select *, a = first_value(a) over (partition by kid, flow_seq order by rn) s,
      (tcp_flags // 2) % 2 = 1 syn, (tcp_flags // 16) % 2 = 1 ack
    from labelled where verdict = 0) q0),
gaps as (select *, ts_us - before gap from accepted),
jitters as (
  select *, abs(gap - lag(gap) over (partition by kid, flow_seq, s order by rn)) jit,
    min(case when not s and syn and ack then rn end) over (partition by kid, flow_seq) synack_rn
  from gaps),
summed as (
  select capture_id, ip_a, port_a, ip_b, port_b, proto, kid, flow_seq,
    bool_or(a) filter (s and nth = 1) src_is_a,
    count(*) filter (s) spkts, count(*) filter (not s) dpkts,
    coalesce(sum(ip_total_len) filter (s), 0) sbytes, coalesce(sum(ip_total_len) filter (not s), 0) dbytes,
    count(*) filter (s and lost) sloss, count(*) filter (not s and lost) dloss,
    coalesce(max(ttl) filter (s and nth = 1), 0) sttl, coalesce(max(ttl) filter (not s and nth = 1), 0) dttl,
    coalesce(max(tcp_window) filter (s and nth = 1), 0) swin,
    coalesce(max(tcp_window) filter (not s and nth = 1), 0) dwin,
    coalesce(bit_or(tcp_flags) filter (s), 0) s_flags, coalesce(bit_or(tcp_flags) filter (not s), 0) d_flags,
    coalesce(sum(gap) filter (s) / count(gap) filter (s) / 1000.0, 0.0) sinpkt,
    coalesce(sum(gap) filter (not s) / count(gap) filter (not s) / 1000.0, 0.0) dinpkt,
    coalesce(sum(jit) filter (s) / count(jit) filter (s) / 1000.0, 0.0) sjit,
    coalesce(sum(jit) filter (not s) / count(jit) filter (not s) / 1000.0, 0.0) djit,
    min(ts_us) stime_us, max(ts_us) ltime_us, max(ts_us) filter (closes) close_us,
    min(ts_us) filter (s and syn and not ack) syn_us, min(ts_us) filter (not s and syn and ack) synack_us,
    min(ts_us) filter (s and ack and not syn and rn > synack_rn) ack_us
  from jitters group by all),
named as (
  select *,
    case when src_is_a then ip_a else ip_b end src, case when src_is_a then port_a else port_b end sport,
    case when src_is_a then ip_b else ip_a end dst, case when src_is_a then port_b else port_a end dsport,
    (ltime_us - stime_us) / 1e6 dur, coalesce(close_us, {emit}) emit_us
  from summed),
measured as (
  select *,
    {ip_text("src")} srcip, {ip_text("dst")} dstip,
    case proto when 6 then 'tcp' when 17 then 'udp' when 1 then 'icmp' else 'other' end proto_name,
    case when proto = 17 then case when spkts > 0 and dpkts > 0 then 'CON' else 'INT' end
         when proto <> 6 then 'ECO'
         when ((s_flags | d_flags) // 4) % 2 = 1 then 'RST'
         when s_flags % 2 = 1 and d_flags % 2 = 1 then 'FIN'
         when dpkts = 0 then 'INT' when synack_us is not null then 'CON' else 'REQ' end state,
    coalesce({service("sport")}, {service("dsport")}, '-') service,
    {ratio("sbytes", "spkts")} smean, {ratio("dbytes", "dpkts")} dmean,
    {ratio("sbytes * 8.0", "dur")} sload, {ratio("dbytes * 8.0", "dur")} dload,
    {ratio("(spkts + dpkts)", "dur")} rate,
    case when proto = 6 then coalesce((synack_us - syn_us) / 1e6, 0.0) else 0.0 end synack,
    case when proto = 6 then coalesce((ack_us - synack_us) / 1e6, 0.0) else 0.0 end ackdat,
    case when src = dst and sport = dsport then 1 else 0 end is_sm_ips_ports,
    row_number() over (partition by capture_id
      order by emit_us, stime_us, ip_a, port_a, ip_b, port_b, proto, flow_seq) - 1 emit_no
  from named),
flows as materialized (
  select * exclude (proto), proto_name proto, synack + ackdat tcprtt,
    case when state = 'FIN' and sttl in (62, 63, 254, 255) and dttl in (252, 253) then 1
         when state = 'INT' and sttl in (0, 62, 254) and dttl = 0 then 2
         when state = 'CON' and sttl in (62, 254) and dttl in (60, 252, 253) then 3
         when state = 'REQ' and sttl = 254 and dttl = 0 then 6 else 0 end ct_state_ttl,
    0 trans_depth, 0 response_body_len, 0 ct_flw_http_mthd, 0 is_ftp_login, 0 ct_ftp_cmd,
    {", ".join(f"{history(keys)} {name}" for name, keys in HISTORY_COUNTS.items())}
  from measured)"""


def ip_text(column: str) -> str:
    return " || '.' || ".join(f"cast(({column} // {1 << s}) % 256 as varchar)" for s in (24, 16, 8, 0))


def service(column: str) -> str:
    return (
        f"case {column} when 80 then 'http' when 8080 then 'http' when 53 then 'dns' when 25 then 'smtp' "
        "when 20 then 'ftp-data' when 21 then 'ftp' when 22 then 'ssh' when 110 then 'pop3' end"
    )


def history(keys: list[str]) -> str:
    return (
        f"count(*) over (partition by capture_id, {', '.join(keys)} order by emit_no "
        "range between 99 preceding and current row)"
    )


def over_labelled(select: str, idle_us: int | None = 60_000_000, every: int | None = None) -> str:
    return f"with recursive {walk_ctes(idle_us, every)} {select}"


def over_flows(select: str, idle_us: int | None = 60_000_000, every: int | None = None, packets: str = PACKETS) -> str:
    return f"with recursive {flow_ctes(idle_us, every, packets)} {select}"


FLOW_RECORD = ", ".join(FLOW_COLUMNS)
