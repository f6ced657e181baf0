"""Matching packets against a rules table.

One set of conditions serves three access paths, which give the same result:

* *compiled*: every rule becomes a column expression with its values folded in. No join, no shuffle.
  For rule sets up to a few hundred rules.
* *indexed*: rules are rows under their transport and, where they name a single destination port, that
  port, and, where they name one network (or address) of the source or the target, that network. Packets meet them in map-side hash joins that test the rule, and the least position per packet
  is kept. The rules are sent in chunks of bounded size, so the broadcast never grows with the rule file.
* *all matches*: the same join, every row of it.

Rules that ask for the same are one class: a packet is tested against a class once, and the class stands for its first rule
or, where all matches count, for its list of rules. Rules that can't fire at all are left out before any packet is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window, functions as F, types as T

from packetloom.functions import net, text
from packetloom.functions.net import ACK, has_flag, ipv4_to_long
from packetloom.operators.alerts import UNKNOWN
from packetloom.operators.chains import cooldown
from packetloom.operators.durable import checkpointed
from packetloom.operators.sliding import sliding_count
from packetloom.schema import ALERT_COLUMNS
from packetloom.sources.rules import parse_rules

COMPILE_LIMIT = 200
CHUNK_RULES = 20_000
#: Smaller chunks than ``CHUNK_RULES`` grow, so that the packets are not read more often than this for them.
PASSES = 4
#: The rules of a class that has more are met in lots of about so many.
CLASS_RULES = 1_000
#: The packets that meet a lot are dealt out in so many parts.
MEMBER_PARTS = 16
ANY_PORT = -1
ANY_NET = -1
#: Networks up to this many host bits are worth a key; a packet probes at most so many forms of network.
KEYED_BITS = 24
FORMS = 12

# Destination ports the http service test accepts.
HTTP_SERVICE_PORTS = [80, 8080, 443, 8443]

Access = Callable[[str], object]


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def prepared(packets: DataFrame) -> DataFrame:
    """Packets with the derived columns the conditions read, computed once per packet."""
    out = packets
    for name, kind in (("payload", "binary"), ("icmp_code", "int"), ("icmp_id", "int")):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    whole = F.coalesce(F.col("frame"), F.col("payload")) if "frame" in out.columns else F.col("payload")
    label = net.protocol_label(
        F.col("arp_op").isNotNull(), net.is_tcp(), net.is_udp(), net.is_icmp(), F.col("src_port"), F.col("dst_port")
    )
    if "proto" not in out.columns:
        out = out.withColumn("proto", label)
    transport = F.when(net.is_tcp(), "tcp").when(net.is_udp(), "udp").when(net.is_icmp(), "icmp").otherwise("other")
    return (
        out.withColumn("__src", ipv4_to_long(F.col("src_ip")))
        .withColumn("__dst", ipv4_to_long(F.col("dst_ip")))
        .withColumn("__bytes", text.byte_text(whole))
        .withColumn("__raw", text.byte_text(F.when(F.length("payload") > 0, F.col("payload"))))
        .withColumn("__folded", F.translate("__bytes", _UPPER, _LOWER))
        .withColumn("__transport", transport)
    )


def _dropped(df: DataFrame) -> DataFrame:
    return df.drop("__src", "__dst", "__bytes", "__folded", "__raw", "__transport")


# ---------------------------------------------------------------- positional rules


def plain_address_match(rule_ip, actual: Column) -> Column:
    raw = _col(rule_ip)
    same = F.substring(raw, 2, 10**6) == actual
    return F.when(raw == "any", True).when(raw.startswith("!"), ~same).otherwise(raw == actual)


def plain_port_match(spec, actual: Column) -> Column:
    """A missing port reads as the word ``any``: no range holds it and no number equals it."""
    part = _member(spec)
    word = F.coalesce(actual.cast("string"), F.lit("any"))
    inside = (actual >= _col(part("lo"))) & (actual <= _col(part("hi")))
    ranged = F.when(inside.isNull(), F.lit(False)).otherwise(inside != _col(part("neg")))
    exact = (_col(part("text")) == word) != _col(part("neg"))
    return F.when(_col(part("any")), True).when(_col(part("range")), ranged).otherwise(exact)


def plain_proto_match(rule_proto, label: Column) -> Column:
    raw = _col(rule_proto)
    return raw.isin("any", "IP") | (raw == label)


def simple_match(r: Access) -> Column:
    """Positional rule against label, addresses and ports."""
    return (
        plain_proto_match(r("proto"), F.col("proto"))
        & plain_address_match(r("src_ip"), F.coalesce("src_ip", F.lit("")))
        & plain_address_match(r("dst_ip"), F.coalesce("dst_ip", F.lit("")))
        & plain_port_match(r("src_spec"), F.col("src_port"))
        & plain_port_match(r("dst_spec"), F.col("dst_port"))
    )


def log_match(r: Access) -> Column:
    """Comparison used by the log analyser: transports only, ICMP ports match any port, one-way rules."""
    transport = F.upper(F.when(F.col("__transport") != "other", F.col("__transport")))
    proto = _col(r("proto"))
    same_proto = (
        F.when(proto == "any", True)
        .when((proto == "IP") & transport.isin("TCP", "UDP"), True)
        .when(proto.startswith("!"), F.substring(proto, 2, 100) != transport)
        .otherwise(proto == transport)
    )

    def port(spec, actual: Column) -> Column:
        part = _member(spec)
        low = F.coalesce(_col(part("lo")), _col(part("text")).try_cast("int"))
        high = F.coalesce(_col(part("hi")), _col(part("text")).try_cast("int"))
        inside = actual.between(low, high) != _col(part("neg"))
        return F.when(_col(part("any")) | actual.isNull(), True).otherwise(inside) & _col(part("positional"))

    return (
        transport.isNotNull()
        & net.is_ip()
        & same_proto
        & plain_address_match(r("src_ip"), F.col("src_ip"))
        & plain_address_match(r("dst_ip"), F.col("dst_ip"))
        & port(r("src_spec"), F.col("src_port"))
        & port(r("dst_spec"), F.col("dst_port"))
        & _col(r("payload")).isin("any", "*")
    )


# ---------------------------------------------------------------- option rules, cheap tests first


def _member(struct) -> Access:
    if isinstance(struct, Column):
        return lambda name: struct[name]
    return lambda name: struct[name]


def in_terms(side, value: Column) -> Column:
    """Negation of a side applies to the whole list; an empty list is satisfied by everything."""
    part = _member(side)
    terms = part("terms")
    if isinstance(terms, Column):
        hit = (F.size(terms) == 0) | F.exists(terms, lambda t: value.between(t["lo"], t["hi"]) != t["neg"])
    else:
        hit = F.lit(not terms)
        for t in terms:
            hit = hit | (value.between(t["lo"], t["hi"]) != F.lit(t["neg"]))
    return _true(hit) != _col(part("neg"))


def transport_match(r: Access) -> Column:
    protocol = _col(r("protocol"))
    wanted = F.when(protocol.isin("tcp", "udp", "icmp"), protocol == F.col("__transport")).otherwise(True)
    return net.is_ip() & wanted


def address_match(r: Access) -> Column:
    return in_terms(r("src_nets"), F.col("__src")) & in_terms(r("dst_nets"), F.col("__dst"))


def port_match(r: Access) -> Column:
    ported = _col(r("protocol")).isin("tcp", "udp")
    return ~ported | (in_terms(r("src_ports"), F.col("src_port")) & in_terms(r("dst_ports"), F.col("dst_port")))


def icmp_match(r: Access) -> Column:
    out = F.lit(True)
    for option, actual in (("icmp_id", "icmp_id"), ("itype", "icmp_type"), ("icode", "icmp_code")):
        wanted = _col(r(option))
        out = out & (wanted.isNull() | _true(F.col(actual) == wanted))
    return (_col(r("protocol")) != "icmp") | out


def ip_protocol_match(r: Access) -> Column:
    """The protocol number of the IP header; a rule without one (or with 0) takes any."""
    wanted = _col(r("ip_proto"))
    return wanted.isNull() | (wanted == 0) | _true(F.col("ip_proto") == wanted)


def flags_match(r: Access) -> Column:
    return (_col(r("protocol")) != "tcp") | _true(net.flags_satisfied(F.col("tcp_flags"), _col(r("flags_mask"))))


def flow_match(r: Access, fix_direction: bool = False) -> Column:
    """``to_server`` wants dport >= sport and ``to_client`` the reverse; ``fix_direction`` swaps them."""
    options = r("flow_options")

    def has(word: str) -> Column:
        return F.array_contains(options, word) if isinstance(options, Column) else F.lit(word in (options or []))

    tcp, ack = net.is_tcp(), has_flag(F.col("tcp_flags"), ACK)
    ported = tcp | net.is_udp()
    up, down = F.col("dst_port") >= F.col("src_port"), F.col("src_port") >= F.col("dst_port")
    if fix_direction:
        up, down = down, up
    return (
        (~has("established") | (tcp & ack))
        & (~has("stateless") | ~(tcp & ack))
        & (~has("to_server") | ~ported | _true(up))
        & (~has("to_client") | ~ported | _true(down))
    )


def _byte_form(value: Column) -> Column:
    return text.byte_text(F.encode(value, "UTF-8"))


# ASCII letters, for byte-wise case folding.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def content_match(r: Access) -> Column:
    """The rule's content inside the frame, honouring offset, depth, nocase and the service hints."""
    nocase, service, given = _col(r("nocase")), _col(r("service")), _col(r("content"))
    offset, depth = F.greatest(_col(r("offset")), F.lit(0)), _col(r("depth"))
    hay = F.when(nocase, F.col("__folded")).otherwise(F.col("__bytes"))
    part = F.substring(hay, offset + 1, F.when(depth > 0, depth).otherwise(F.length(hay)))
    hay = F.when(_col(r("fast_pattern")), hay).otherwise(part)
    needle = F.when(nocase, F.lower(given)).otherwise(given)
    as_bytes = _byte_form(needle)
    http = service == "http"
    requested = F.contains(hay, F.concat(F.lit("GET "), as_bytes, F.lit(" HTTP"))) | F.contains(
        hay, F.concat(F.lit("POST "), as_bytes, F.lit(" HTTP"))
    )
    found = (
        F.when(http & needle.startswith("/"), requested)
        .when(http & (needle == "&"), F.contains(hay, F.lit("&")))
        .when(service == "dns", F.contains(hay, F.lit("\x00")) | F.contains(hay, F.lit("\x01")))
        .otherwise(F.contains(hay, as_bytes))
    )
    return (given == "") | _true((F.length("__bytes") > 0) & found)


def header_contains(payload: Column, wanted: str) -> Column:
    """Text in a header name or value of an HTTP message, or anywhere in it as written."""
    raw = text.byte_text(payload)
    looks_http = F.lit(False)
    for word in ("HTTP/", "GET ", "POST ", "PUT ", "DELETE ", "HEAD "):
        looks_http = looks_http | F.contains(raw, F.lit(word))
    folded = wanted.lower()
    in_headers = F.exists(
        text.http_headers(payload),
        lambda h: F.contains(F.lower(h["v"]), F.lit(folded)) | F.contains(h["k"], F.lit(folded)),
    )
    return _true(looks_http & (in_headers | F.contains(raw, _byte_form(F.lit(wanted)))))


def uri_contains(payload: Column, wanted: str, *, nocase: bool = False) -> Column:
    """Text in the URI of an HTTP request; an empty text only asks for a request."""
    uri = text.http_uri(payload)
    if nocase:
        return _true(F.contains(F.lower(uri), F.lit(wanted.lower())))
    return _true(F.contains(uri, F.lit(wanted)))


def service_match(r: Access) -> Column:
    wrong = (_col(r("service")) == "http") & net.is_tcp() & ~_true(F.col("dst_port").isin(HTTP_SERVICE_PORTS))
    return ~wrong


def pcre_match(r: Access, mode: str = "reference") -> Column:
    """``reference``: a rule with a pcre never fires. ``on``: the pattern is searched in the frame."""
    given = _col(r("pcre"))
    if mode == "reference":
        return given == ""
    body = F.regexp_extract(given, '"/(.*?)/(.*?)"', 1)
    letters = F.regexp_extract(given, '"/(.*?)/(.*?)"', 2)
    flags = F.lit("d")
    for letter in "ims":
        flags = F.concat(flags, F.when(F.contains(letters, F.lit(letter)), letter).otherwise(""))
    pattern = F.concat(F.lit("(?"), flags, F.lit(")"), body)
    return (given == "") | _true(given.rlike('"/(.*?)/(.*?)"') & F.regexp_like(F.col("__bytes"), pattern))


def byte_test_match(r: Access) -> Column:
    return _col(r("byte_test")) == ""


def specificity_match(r: Access) -> Column:
    """Plausibility of the payload for what the rule looks for."""
    service, given = _col(r("service")), _col(r("content"))
    raw, flow = F.col("__raw"), _col(r("flow"))
    has_raw = raw.isNotNull()

    def holds(word: str) -> Column:
        return F.contains(raw, F.lit(word))

    http = service == "http"
    uri_rule = http & given.startswith("/")
    uri_ok = has_raw & (holds("GET ") | holds("POST ") | holds("PUT "))
    amp_rule = http & (given == "&")
    amp_form = holds("Content-Length:") | holds("application/x-www-form-urlencoded")
    dns_ok = has_raw & (F.length(raw) >= 12) & (F.ascii(F.substring(raw, 3, 1)).bitwiseAND(0x80) == 0)
    established_ok = ~net.is_tcp() | has_flag(F.col("tcp_flags"), ACK)
    rest = (~(service == "dns") | _true(dns_ok)) & (~F.contains(flow, F.lit("established")) | established_ok)
    # An ampersand in a form decides the question at once, whatever else the rule asks for.
    return (
        F.when(uri_rule & ~_true(uri_ok), False)
        .when(amp_rule & ~has_raw, False)
        .when(amp_rule & _true(holds("&")), _true(amp_form))
        .otherwise(rest)
    )


def staged_match(r: Access, *, pcre: str = "reference", fix_direction: bool = False) -> Column:
    """All tests of an option rule. Directions other than ``->`` are not looked at."""
    return _true(
        transport_match(r)
        & address_match(r)
        & port_match(r)
        & ip_protocol_match(r)
        & icmp_match(r)
        & flags_match(r)
        & flow_match(r, fix_direction)
        & service_match(r)
        & byte_test_match(r)
        & content_match(r)
        & pcre_match(r, pcre)
        & specificity_match(r)
    )


def can_fire(r: Access, pcre: str = "reference") -> Column:
    """Whether any packet can meet the rule, as far as the rule alone tells."""
    staged = byte_test_match(r)
    if pcre == "reference":
        staged = staged & pcre_match(r, pcre)
    return (_col(r("kind")) != "snort") | staged


def rule_match(r: Access, **options) -> Column:
    """Option rules are matched on the packet, positional ones on the five-tuple."""
    kind = r("kind")
    if not isinstance(kind, Column):
        return staged_match(r, **options) if kind == "snort" else _true(simple_match(r))
    return F.when(kind == "snort", staged_match(r, **options)).otherwise(_true(simple_match(r)))


# ---------------------------------------------------------------- first match


def _finish_first(df: DataFrame) -> DataFrame:
    return (
        _dropped(df)
        .withColumn("rule_pos", F.col("__hit.pos"))
        .withColumn("matched_rule", F.col("__hit.label"))
        .withColumn("is_alert", F.col("__hit").isNotNull())
        .withColumn("threat", F.when(F.col("__hit").isNotNull(), "CRITICAL").otherwise("LOW"))
        .drop("__hit")
    )


def first_match_compiled(packets: DataFrame, rules: list[Row], **options) -> DataFrame:
    """Packets with the first rule, in file order, that matches; rules are folded into the plan.

    As columns, if no more than ``COMPILE_LIMIT`` of them differ in what they ask for, else as rows of the plan that packets meet by key.
    """

    def access(row: Row) -> Access:
        values = row.asDict(recursive=True)
        return lambda name: values[name]

    def hit(row: Row) -> Column:
        found = F.struct(F.lit(row["rule_pos"]).cast("long").alias("pos"), F.lit(row["label"]).alias("label"))
        return F.when(rule_match(access(row), **options), found)

    none = F.lit(None).cast("struct<pos:bigint,label:string>")
    first = {}
    for r in sorted(rules, key=lambda r: r["rule_pos"]):  # a rule that asks for the same as an earlier one is never first
        first.setdefault(tuple(repr(r[name]) for name in CONDITIONS), r)
    ordered = list(first.values())
    if len(ordered) > COMPILE_LIMIT:
        table = packets.sparkSession.createDataFrame([tuple(r[name] for name in RULE_FIELDS) for r in ordered], _rule_schema(packets.sparkSession))
        return first_match_indexed(packets, table, rule_count=len(ordered), **options)
    chain = F.coalesce(*[hit(r) for r in ordered], none) if ordered else none
    return _finish_first(_once(prepared(packets), chain))


def _once(packets: DataFrame, hit: Column) -> DataFrame:
    """Add ``__hit`` through a generator, so that later filters on it do not match every rule again."""
    return packets.select("*", F.explode(F.array(hit)).alias("__hit"))


def _net_code(form: Column, address: Column) -> Column:
    """A network as a number: its form (side and host bits) and its address without the host bits."""
    return F.shiftleft(form.cast("long"), 32) + F.call_function("shiftright", address, form % 64)


def _net_key(side: int, name: str) -> Column:
    """(bits, form, code) of the one network a rule asks for on a side; NULL if it asks for more, for all but one, or for any."""
    nets, raw = F.col(f"{name}_nets"), ipv4_to_long(F.col(f"{name}_ip"))
    one = F.get(nets["terms"], F.lit(0))
    size = one["hi"] - one["lo"] + 1
    bits = F.length(F.bin(size)) - 1
    whole = ~nets["neg"] & (F.size(nets["terms"]) == 1) & ~one["neg"] & (F.bit_count(size) == 1) & (one["lo"] % size == 0) & (bits <= KEYED_BITS)
    form = lambda b: (F.lit(64 * side) + b).cast("int")
    key = lambda b, lo: F.struct(b.cast("int").alias("bits"), form(b).alias("form"), _net_code(form(b), lo).alias("code"))
    return F.when((F.col("kind") == "snort") & whole, key(bits, one["lo"])).when((F.col("kind") == "simple") & raw.isNotNull(), key(F.lit(0), raw))


def _keyed(rules: DataFrame) -> DataFrame:
    """One row per (transport, destination port or any port, network or any network) a rule can apply to."""
    transports = (
        F.when(F.col("kind") == "simple", _simple_transports())
        .when(F.col("protocol").isin("tcp", "udp", "icmp"), F.array("protocol"))
        .otherwise(F.array(*[F.lit(t) for t in ("tcp", "udp", "icmp", "other")]))
    )
    terms, spec = F.col("dst_ports.terms"), F.col("dst_spec")
    one = F.get(terms, F.lit(0))
    staged = (
        F.col("protocol").isin("tcp", "udp")
        & ~F.col("dst_ports.neg")
        & (F.size(terms) == 1)
        & ~one["neg"]
        & (one["lo"] == one["hi"])
    )
    plain = ~spec["any"] & ~spec["neg"] & ~spec["range"] & spec["text"].rlike("^(0|[1-9][0-9]{0,8})$")
    port = (
        F.when((F.col("kind") == "snort") & staged, one["lo"].cast("int"))
        .when((F.col("kind") == "simple") & plain, spec["text"].try_cast("int"))
        .otherwise(F.lit(ANY_PORT))
    )
    narrowest = F.array_min(F.array_compact(F.array(_net_key(0, "src"), _net_key(1, "dst"))))
    return rules.withColumn("__key_port", port).withColumn("__key_net", narrowest).withColumn("__key_transport", F.explode(transports))


def _simple_transports() -> Column:
    """Transports whose label a positional protocol can equal."""
    tcp, udp = F.col("proto").isin("TCP", "HTTP", "TLS", "SSH", "FTP", "SMTP"), F.col("proto").isin("UDP", "DNS")
    return (
        F.when(tcp, F.array(F.lit("tcp")))
        .when(udp, F.array(F.lit("udp")))
        .when(F.col("proto") == "ICMP", F.array(F.lit("icmp")))
        .otherwise(F.array(*[F.lit(t) for t in ("tcp", "udp", "icmp", "other")]))
    )


# Columns of a rule that the conditions read.
RULE_FIELDS = [
    "rule_pos", "kind", "label", "proto", "protocol", "src_ip", "dst_ip", "src_spec", "dst_spec", "src_nets", "dst_nets",
    "src_ports", "dst_ports", "service", "flow", "flow_options", "flags_mask", "content", "nocase", "depth", "offset",
    "fast_pattern", "pcre", "itype", "icode", "icmp_id", "ip_proto", "byte_test",
]


# What the conditions test, and what the keys of a rule are made of.
CONDITIONS = [name for name in RULE_FIELDS if name not in ("rule_pos", "label")]
KEY_FIELDS = ["kind", "proto", "protocol", "src_ip", "dst_ip", "dst_spec", "src_nets", "dst_nets", "dst_ports"]


def _rule_schema(spark) -> T.StructType:
    parsed = parse_rules(spark.createDataFrame([], "line int, text string")).schema
    return T.StructType([T.StructField(name, parsed[name].dataType) for name in RULE_FIELDS])


def _read_by(condition: Callable[[Access], Column]) -> list[str]:
    """The fields of a rule that a condition reads, and those of its keys."""
    read = dict.fromkeys(KEY_FIELDS)

    def access(name: str) -> Column:
        read.setdefault(name)
        return F.col(name)

    condition(access)
    return list(read)


def leading(rules: DataFrame, **options) -> DataFrame:
    """The rules that can come first: of those that ask for the same only the earliest, and none that can't fire."""
    fields = CONDITIONS
    firing = rules.where(can_fire(F.col, options.get("pcre", "reference")))
    first = firing.groupBy(*fields).agg(F.min(F.struct("rule_pos", "label")).alias("__first"))
    return first.select(*fields, "__first.*").select(*RULE_FIELDS)


def _chunks(total: int, chunk_rules: int) -> int:
    """Number of passes over the packets: as many as ``chunk_rules`` asks for, but no more than ``PASSES`` of less than ``CHUNK_RULES``."""
    return max(1, -(-total // max(chunk_rules, min(CHUNK_RULES, -(-total // PASSES)))))


def _candidates(packets: DataFrame, keyed: DataFrame, rule_columns: list[str], total: int, chunk_rules: int, condition) -> DataFrame:
    """One row per (packet, rule that meets ``condition``), the rule as ``__rule``.

    Packets probe the rules of their transport under their destination port and under no single port, for their two
    addresses in the commonest forms of network that the rules name (of which there are few) and under no network. Rules are
    broadcast in chunks of at most ``chunk_rules``, each with a pass over the packets.
    """
    chunks = _chunks(total, chunk_rules)
    named = keyed.where(F.col("__key_net").isNotNull()).groupBy(F.col("__key_net.form").alias("form")).agg(F.count("*").alias("n"))
    forms = [r["form"] for r in named.orderBy(F.desc("n"), "form").limit(FORMS).collect()]
    nets = [F.lit(ANY_NET).cast("long"), *[_net_code(F.lit(f), F.col("__dst" if f >= 64 else "__src")) for f in forms]]
    ports = [F.coalesce("dst_port", F.lit(ANY_PORT)), F.lit(ANY_PORT)]
    probes = F.array_distinct(F.array(*[F.struct(p.alias("port"), n.alias("net")) for p in ports for n in nets]))
    left = prepared(packets).withColumn("__probe", F.explode(F.filter(probes, lambda p: p["net"].isNotNull())))
    net = F.when(F.col("__key_net.form").isin(forms), F.col("__key_net.code")).otherwise(ANY_NET) if forms else F.lit(ANY_NET).cast("long")
    table = keyed.select("__key_transport", "__key_port", net.alias("__key_net"), F.struct(*rule_columns).alias("__rule"))
    on = (F.col("__transport") == F.col("__key_transport")) & (F.col("__probe.port") == F.col("__key_port")) & (F.col("__probe.net") == F.col("__key_net"))
    on = on & condition(lambda name: F.col("__rule")[name])
    found = None
    for i in range(chunks):
        part = table if chunks == 1 else table.where(F.pmod(F.xxhash64("__rule.rule_pos"), F.lit(chunks)) == i)
        joined = left.join(F.broadcast(part), on).drop("__probe", "__key_transport", "__key_port", "__key_net")
        found = joined if found is None else found.unionByName(joined)
    return found


def first_hits(packets: DataFrame, rules: DataFrame, *, rule_count: int | None = None, chunk_rules: int = CHUNK_RULES, **options) -> DataFrame:
    """``packet_id`` and ``__hit`` (position, label) of the packets that a rule matches.

    Rules are rows, joined by (transport, destination port) and tested in the join; the least position per packet is
    taken where the rows arise before anything is shuffled, so only hits travel.
    """
    first = leading(rules, **options).persist()
    total = first.count() if rule_count is None else rule_count
    found = _candidates(packets, _keyed(first), RULE_FIELDS, total, chunk_rules, lambda access: rule_match(access, **options))
    hit = F.struct(F.col("__rule.rule_pos").cast("long").alias("pos"), F.col("__rule.label").alias("label"))
    return found.groupBy("packet_id").agg(F.min(hit).alias("__hit"))


def first_match_indexed(packets: DataFrame, rules: DataFrame, *, rule_count: int | None = None, chunk_rules: int = CHUNK_RULES, **options) -> DataFrame:
    """Same result as the compiled path for rule sets of any size. ``packet_id`` identifies a packet."""
    hits = first_hits(packets, rules, rule_count=rule_count, chunk_rules=chunk_rules, **options)
    return _finish_first(prepared(packets).join(hits, "packet_id", "left"))


def first_match(
    packets: DataFrame, rules: DataFrame, *, compile_limit: int = COMPILE_LIMIT, rule_count: int | None = None, chunk_rules: int = CHUNK_RULES, **options
) -> DataFrame:
    """First matching rule per packet; the access path follows the size of the rule set, the result does not."""
    good = leading(rules.where(F.col("error").isNull()), **options).persist()  # read several times, and costly to parse
    few = good.limit(compile_limit + 1).collect()
    if len(few) <= compile_limit:
        return first_match_compiled(packets, few, **options)
    return first_match_indexed(packets, good, rule_count=rule_count, chunk_rules=chunk_rules, **options)


# ---------------------------------------------------------------- all matches


def all_matches(
    packets: DataFrame, rules: DataFrame, *, condition: Callable[[Access], Column] = staged_match, chunk_rules: int = CHUNK_RULES
) -> DataFrame:
    """One row per (packet, matching rule): ``rule_pos``, ``sid``, ``rule``, ``detection_filter`` and the packet's columns.

    Packets meet the rules of their transport that name their destination port or no single port.
    Rules that agree in all that ``condition`` reads are tested at once; a packet that meets such a class becomes a row for each of its rules.
    The classes are broadcast in chunks of at most ``chunk_rules``, without their rules.
    """
    good = rules.where(F.col("error").isNull())
    staged = condition is staged_match
    if staged:
        good = good.withColumn("kind", F.lit("snort")).where(can_fire(F.col))
    fields = _read_by(condition)
    member = F.struct("rule_pos", "sid", F.col("label").alias("rule"), "detection_filter")
    kept = checkpointed(good.select(F.struct(*fields).alias("__asks"), member.alias("__rule")))  # costly to parse
    classes = checkpointed(_classes(kept.select("__asks.*", "__rule.rule_pos"), fields))
    found = _classes_met(packets, classes, fields, condition, chunk_rules, staged)
    met = _dropped(found).select("*", F.col("__rule.__class").alias("__key"), F.col("__rule.__lots").alias("__lots")).drop("__rule")
    asked = classes.select(F.struct(*fields).alias("__asked"), "__class", "__lots")
    placed = kept.join(asked, F.col("__asks") == F.col("__asked"))  # fields without a value are equal inside a struct
    lot = F.pmod(F.xxhash64("__rule.rule_pos", "__rule.sid"), F.col("__lots")).cast("int")
    return _each_rule(met, placed.select(F.col("__class").alias("__key"), lot.alias("__lot"), "__rule.*"))


def _classes(rules: DataFrame, fields: list[str]) -> DataFrame:
    """Rules that agree in ``fields`` as a row: the first's ``rule_pos``, a number and how many lots of ``CLASS_RULES`` they are."""
    classes = rules.groupBy(*fields).agg(F.min("rule_pos").alias("rule_pos"), F.ceil(F.count("*") / F.lit(CLASS_RULES)).cast("int").alias("__lots"))
    return classes.withColumn("__class", F.monotonically_increasing_id())


def _classes_met(packets: DataFrame, classes: DataFrame, fields: list[str], condition, chunk_rules: int, by_key: bool) -> DataFrame:
    """One row per (packet, class of rules that meets ``condition``), the class as ``__rule``.

    Only ports and networks of option rules are keys (``by_key``); other conditions are tested on every packet.
    """
    keyed = _keyed(classes)
    if not by_key:
        none = F.lit(None).cast("struct<bits:int,form:int,code:bigint>")
        every = F.array(*[F.lit(t) for t in ("tcp", "udp", "icmp", "other")])
        keyed = classes.withColumn("__key_port", F.lit(ANY_PORT)).withColumn("__key_net", none).withColumn("__key_transport", F.explode(every))
    columns = list(dict.fromkeys([*fields, "rule_pos", "__class", "__lots"]))
    return _candidates(packets, keyed, columns, classes.count(), chunk_rules, condition)


def _each_rule(hits: DataFrame, members: DataFrame) -> DataFrame:
    """``hits`` as a row for each rule of their ``__key``, of which ``members`` holds ``__lots`` lots; one that is a rule itself and has no members stays.

    Both sides are dealt out by key, lot and a part of the packets and sorted so. No list of rules is broadcast or held whole by a task, and
    the rows of a lot follow each other: its rules come again within a page of a columnar file, which takes a fraction of the bytes.
    """
    rules_too = "rule_pos" in hits.columns
    shown = [c for c in members.columns if c not in ("__key", "__lot") and (not rules_too or c in hits.columns)]
    partitions = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lots = members.groupBy("__key", "__lot").agg(F.sort_array(F.collect_list(F.struct(*shown))).alias("__list"))
    # one array for each column, so that those nobody asks for are left out early
    right = lots.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(MEMBER_PARTS - 1)))).select(
        *[F.col(c).alias(f"__its_{c}") for c in ("__key", "__lot", "__part")], *[F.col(f"__list.{c}").alias(f"__its_{c}") for c in shown]
    )
    left = hits.withColumn("__lot", F.explode(F.sequence(F.lit(0), F.col("__lots") - 1)))
    left = left.withColumn("__part", F.pmod(F.xxhash64("packet_id"), F.lit(MEMBER_PARTS)).cast("int")).repartition(partitions, "__key", "__lot", "__part")
    same = F.lit(True)
    for c in ("__key", "__lot", "__part"):
        same = same & (F.col(c) == F.col(f"__its_{c}"))
    found = left.join(right.hint("merge"), same, "left" if rules_too else "inner")

    def values(c: str) -> Column:
        return F.coalesce(f"__its_{c}", F.array(c)) if rules_too else F.col(f"__its_{c}")

    kept = [c for c in hits.columns if c not in (*shown, "__key", "__lots")]
    listed = found.select(*kept, *[values(c).alias(f"__its_{c}") for c in shown])
    numbered = listed.select("*", F.posexplode(f"__its_{shown[0]}").alias("__at", shown[0]))
    return numbered.select(*kept, shown[0], *[F.get(f"__its_{c}", F.col("__at")).alias(c) for c in shown[1:]])


def detection_filter(hits: DataFrame, *, ts: str = "ts", slice_seconds: float = 600.0) -> DataFrame:
    """Hits whose rule has no threshold, and those at which the tracked key reaches it.

    The threshold counts the rule's hits in ``[t - seconds, t]`` per source, target, pair or rule.
    """
    limit = F.col("detection_filter")
    active = F.coalesce(limit["active"], F.lit(False))
    free = hits.where(~active).drop("detection_filter")
    track = F.coalesce(limit["track"], F.lit("by_src"))
    key = (
        F.when(track == "by_src", F.col("src_ip"))
        .when(track == "by_dst", F.col("dst_ip"))
        .when(track == "by_src_dst", F.concat("src_ip", F.lit("->"), "dst_ip"))
        .otherwise(F.col("sid"))
    )
    bound = hits.where(active & limit["count"].isNotNull() & limit["seconds"].isNotNull())
    bound = (
        bound.withColumn("__track", key)
        .withColumn("__seconds", limit["seconds"])
        .withColumn("__count", limit["count"])
        .withColumn("__tie", F.struct("packet_id", "rule_pos"))
    )
    counted = sliding_count(
        bound, ["sid", "__track", "__seconds"], F.col("__seconds"), ts=ts, tie="__tie", slice_seconds=slice_seconds
    )
    reached = counted.where(F.col("n") >= F.col("__count")).drop(
        "n", "__track", "__seconds", "__count", "__tie", "detection_filter"
    )
    return free.unionByName(reached)


def not_broadcast() -> Column:
    return ~F.coalesce(F.col("dst_ip").endswith(".255"), F.lit(False))


def stand_ins(rules: DataFrame, condition: Callable[[Access], Column] = staged_match) -> tuple[DataFrame, DataFrame]:
    """One rule for all that agree in what ``condition`` reads and in their threshold, and the rules that each stands for.

    Only rules whose sid no other rule has stand together: they have the same hits, so the same thresholds and suppressions. Rules that
    share a sid are counted and suppressed together, so each stays for itself and is not among the second. ``with_members`` has the rows of all.
    """
    same = [*_read_by(condition), "detection_filter"]
    held = rules.where(F.col("error").isNull()).withColumn("__of", F.count("*").over(Window.partitionBy("sid")))
    order = Window.partitionBy("__of", *same).orderBy("rule_pos", "sid")
    first = F.first(F.struct("rule_pos", "sid")).over(order)
    ranked = checkpointed(held.withColumn("__key", F.when(F.col("__of") == 1, first)).withColumn("__at", F.row_number().over(order)))  # costly to parse
    lot = F.floor((F.col("__at") - 1) / CLASS_RULES).cast("int")
    members = ranked.where("__of = 1").select("__key", lot.alias("__lot"), "rule_pos", "sid", F.col("label").alias("rule"))
    return ranked.where("__of > 1 OR __at = 1").drop("__of", "__key", "__at"), members


def with_members(hits: DataFrame, members: DataFrame) -> DataFrame:
    """``hits`` of stand-ins as rows of all rules that they stand for."""
    many = members.groupBy(F.col("__key").alias("__of")).agg((F.max("__lot") + 1).alias("__lots")).where("__lots > 1")  # few: the rest has a lot
    keyed = hits.withColumn("__key", F.struct("rule_pos", "sid")).join(F.broadcast(many), F.col("__key") == F.col("__of"), "left").drop("__of")
    return _each_rule(keyed.withColumn("__lots", F.coalesce("__lots", F.lit(1))), members)


def signature_alerts(packets: DataFrame, rules: DataFrame, *, seconds: float = 60.0, **options) -> DataFrame:
    """All matches, thresholded, without broadcast targets, at most one per rule and pair in ``seconds``.

    Rules that agree are counted and suppressed once; what is left of them becomes a row for each. Rules and hits are checkpoints, so
    that no later step plans the grammar and the tests of the rules again.
    """
    few, members = stand_ins(rules, options.get("condition", staged_match))
    columns = ["packet_id", "ts", "sid", "rule_pos", "rule", "src_ip", "dst_ip"]
    matches = all_matches(packets.where(net.is_ip()), few, **options)
    hits = detection_filter(checkpointed(matches.select(*columns, "detection_filter"))).where(not_broadcast())
    slim = hits.withColumn("__tie", F.struct("packet_id", "rule_pos"))
    kept = cooldown(slim, ["sid", "src_ip", "dst_ip"], seconds, strict=False, tie="__tie").drop("__tie")
    return with_members(kept, members).select(*columns)


def rule_match_alerts(matched: DataFrame) -> DataFrame:
    """One critical alert per packet that a rule matched."""
    endpoint = lambda ip, port: F.concat_ws(":", F.col(ip), F.col(port).cast("string"))
    info = F.concat_ws(" ", "proto", endpoint("src_ip", "src_port"), F.lit(">"), endpoint("dst_ip", "dst_port"))
    return matched.where("is_alert").select(
        "ts",
        F.lit("RuleMatch").alias("detector"),
        F.lit(None).cast("int").alias("sid"),
        F.col("threat"),
        F.lit("Rule Match").alias("type"),
        F.coalesce("src_ip", F.lit(UNKNOWN)).alias("src"),
        F.coalesce("dst_ip", F.lit(UNKNOWN)).alias("dst"),
        "proto",
        F.col("matched_rule").alias("rule"),
        info.alias("info"),
        "packet_id",
    ).select(*ALERT_COLUMNS)


def log_matches(packets: DataFrame, rules: DataFrame, *, chunk_rules: int = CHUNK_RULES) -> DataFrame:
    """First rule of the log analyser per matching packet; ``rules`` are already one-way."""
    def condition(r: Access) -> Column:
        return _true(log_match(r))

    fields = _read_by(condition)
    classes = checkpointed(_classes(rules.where(F.col("error").isNull()), fields))
    found = _classes_met(packets, classes, fields, condition, chunk_rules, False)
    return found.groupBy("packet_id").agg(F.min("__rule.rule_pos").alias("rule_pos"))
