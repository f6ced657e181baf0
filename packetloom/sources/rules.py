"""Rule files to a rules table: both grammars, network variables, and the lines that do not parse.

Everything is an expression over text rows. The result is a small table with one row per rule, in
file order, holding the rule as written plus the normalised address and port terms the matchers
use. A term list is ``array<struct<neg, lo, hi>>``: a value satisfies it when some term holds; an
empty list means the side is not restricted.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from packetloom.functions.net import ipv4_to_long, required_bits

# Rule actions and transport words of the option grammar, and the network variables.
RULE_ACTIONS = ["alert", "drop", "reject", "pass", "log", "sdrop", "block", "rewrite", "react"]
TRANSPORTS = ["tcp", "udp", "icmp", "ip"]
NETWORK_VARIABLES = {
    "HOME_NET": ["192.168.0.0/16", "10.0.0.0/8", "172.16.0.0/12"],
    "EXTERNAL_NET": "!$HOME_NET",
    "HTTP_SERVERS": "$HOME_NET",
    "SMTP_SERVERS": "$HOME_NET",
    "SQL_SERVERS": "$HOME_NET",
    "DNS_SERVERS": "$HOME_NET",
    "TELNET_SERVERS": "$HOME_NET",
    "HTTP_PORTS": [80, 443, 8080, 8443],
    "SHELLCODE_PORTS": "!80",
    "ORACLE_PORTS": 1521,
}

TOP_ADDRESS = 2**32 - 1
TOP_PORT = 65535
TERMS = "array<struct<neg:boolean,lo:bigint,hi:bigint>>"


def settled(rows: DataFrame) -> DataFrame:
    """Same rows, computed once: the optimiser does not copy expressions across a generator.

    The grammars are long expressions that use each intermediate result many times.
    """
    return rows.select(F.explode(F.array(F.struct(*[F.col(c) for c in rows.columns]))).alias("__row")).select("__row.*")


# ---------------------------------------------------------------- network variables


def resolve_variable(name: str, variables: dict) -> list[str]:
    """Values of a variable; unknown names and negated references resolve to nothing."""
    value = variables.get(name.lstrip("$"))
    if value is None:
        return []
    if isinstance(value, str):
        if value.startswith("!$"):
            return []
        return resolve_variable(value, variables) if value.startswith("$") else [value]
    return [str(v) for v in value] if isinstance(value, list) else [str(value)]


def _variable_terms(name: str, variables: dict, one_value, top: int) -> list[tuple[bool, int, int]]:
    terms = []
    for text in resolve_variable(name, variables):
        negated = False
        while text.startswith("!"):
            negated, text = not negated, text[1:]
        if text.lower() in ("any", "*"):
            inner = [(False, 0, top)]
        elif text.startswith("$"):
            inner = _variable_terms(text, variables, one_value, top) or [(False, 0, top)]
        else:
            inner = [(False, *one_value(text))]
        if negated and len(inner) > 1:
            raise ValueError(f"variable {name}: a negated list inside a list cannot be expressed")
        terms += [(negated != n, lo, hi) for n, lo, hi in inner]
    return terms


def _address_value(text: str) -> tuple[int, int]:
    try:
        net = ipaddress.IPv4Network(text, strict=False)
    except ValueError:
        return 1, 0
    return int(net.network_address), int(net.broadcast_address)


def _port_value(text: str) -> tuple[int, int]:
    low, _, high = text.strip("[]").partition(":")
    try:
        if ":" in text:
            return (int(low) if low else 0, int(high) if high else TOP_PORT)
        return int(low), int(low)
    except ValueError:
        return 1, 0


def _terms_sql(terms: list[tuple[bool, int, int]]) -> str:
    items = ", ".join(f"named_struct('neg', {str(n).lower()}, 'lo', {lo}L, 'hi', {hi}L)" for n, lo, hi in terms)
    return f"cast(array({items}) as {TERMS})"


def _no_terms() -> Column:
    return F.expr(_terms_sql([]))


def _variable_lookup(core: Column, variables: dict, one_value, top: int) -> Column:
    """Terms of the variable named in ``core``; an empty list when it resolves to nothing."""
    if not variables:
        return _no_terms()
    entries = ", ".join(
        f"'{name}', {_terms_sql(_variable_terms(name, variables, one_value, top))}" for name in variables
    )
    return F.coalesce(F.try_element_at(F.expr(f"map({entries})"), F.ltrim(core, F.lit("$"))), _no_terms())


# ---------------------------------------------------------------- address and port terms


def _bangs(raw: Column) -> Column:
    return F.length(F.regexp_extract(raw, "^(!*)", 1))


def _odd_bangs(raw: Column) -> Column:
    return _bangs(raw) % 2 == 1


def _single_term(lo: Column, hi: Column) -> Column:
    """One term, or one that nothing satisfies where a bound is missing."""
    good = lo.isNotNull() & hi.isNotNull()
    return F.array(
        F.struct(
            F.lit(False).alias("neg"),
            F.when(good, lo).otherwise(F.lit(1)).alias("lo"),
            F.when(good, hi).otherwise(F.lit(0)).alias("hi"),
        )
    ).cast(TERMS)


def address_terms(raw: Column, variables: dict) -> Column:
    """struct<neg, terms> of an address: any, ``*``, ``!``, ``$VAR``, network or exact address."""
    core = F.regexp_replace(raw, "^!+", "")
    base = ipv4_to_long(F.substring_index(core, "/", 1))
    suffix = F.substring_index(core, "/", -1)
    bits = F.when(suffix.rlike("^[0-9]{1,2}$"), suffix.try_cast("int"))
    mask = F.coalesce(
        F.when(bits <= 32, F.lit(2**32) - F.pow(F.lit(2.0), 32 - bits).cast("long")), ipv4_to_long(suffix)
    )
    hosts = F.lit(TOP_ADDRESS) - mask
    is_mask = hosts.bitwiseAND(hosts + 1) == 0
    low = F.when(is_mask, base.bitwiseAND(mask))
    terms = (
        F.when(F.lower(core).isin("any", "*"), _no_terms())
        .when(core.startswith("$"), _variable_lookup(core, variables, _address_value, TOP_ADDRESS))
        .when(F.contains(core, F.lit("/")), _single_term(low, low + hosts))
        .otherwise(_single_term(base, base))
    )
    return F.struct(_odd_bangs(raw).alias("neg"), terms.alias("terms"))


def port_terms(raw: Column, variables: dict) -> Column:
    """struct<neg, terms> of a port: any, ``$VAR``, ``!``, ``n``, ``a,b``, ``a:``, ``:b``, ``a:b``, bracketed or not."""
    core = F.regexp_replace(raw, "^!+", "")
    inner = F.when(core.rlike(r"^\[.*\]$"), F.substring(core, F.lit(2), F.length(core) - 2)).otherwise(core)
    parts = F.split(inner, ":")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    usable = (F.size(parts) == 2) & (F.length(inner) > 1)
    low = F.when(usable, F.when(first == "", F.lit(0)).otherwise(first.try_cast("int"))).cast("long")
    high = F.when(usable, F.when(second == "", F.lit(TOP_PORT)).otherwise(second.try_cast("int"))).cast("long")
    listed = F.transform(F.split(inner, ","), lambda p: F.trim(p).try_cast("int").cast("long"))
    list_terms = F.when(
        F.exists(listed, lambda p: p.isNull()), _single_term(F.lit(None).cast("long"), F.lit(0).cast("long"))
    ).otherwise(F.transform(listed, lambda p: F.struct(F.lit(False).alias("neg"), p.alias("lo"), p.alias("hi"))).cast(TERMS))
    terms = (
        F.when(F.lower(core).isin("any", "*"), _no_terms())
        .when(core.startswith("$"), _variable_lookup(core, variables, _port_value, TOP_PORT))
        .when(F.contains(inner, F.lit(":")), _single_term(low, high))
        .otherwise(list_terms)
    )
    return F.struct(_odd_bangs(raw).alias("neg"), terms.alias("terms"))


def plain_port_spec(raw: Column) -> Column:
    """Port of the positional grammar: any, exact text or ``[lo-hi]``, with one optional ``!``."""
    core = F.regexp_replace(raw, "^!", "")
    bracketed = core.rlike(r"^\[.*\]$")
    ends = F.split(F.regexp_replace(core, r"^\[|\]$", ""), "-")
    two = bracketed & (F.size(ends) == 2)
    return F.struct(
        (raw == "any").alias("any"),
        raw.startswith("!").alias("neg"),
        bracketed.alias("range"),
        F.when(two, F.get(ends, F.lit(0)).try_cast("int")).alias("lo"),
        F.when(two, F.get(ends, F.lit(1)).try_cast("int")).alias("hi"),
        core.alias("text"),
        raw.rlike(r"^(any|!?[0-9]+|!?\[[0-9]+-[0-9]+\])$").alias("positional"),
    )


# ---------------------------------------------------------------- the two grammars


def _option_list(block: Column) -> Column:
    """array<struct<k, v>> split at semicolons outside double quotes."""
    pieces = F.regexp_extract_all(block, F.lit('((?:[^";]++|"[^"]*+(?:"|$))++)'), F.lit(1))
    filled = F.filter(F.transform(pieces, lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(
        filled,
        lambda p: F.struct(
            F.lower(F.trim(F.substring_index(p, ":", 1))).alias("k"),
            F.when(F.contains(p, F.lit(":")), F.trim(F.substring(p, F.instr(p, ":") + 1, F.length(p))))
            .otherwise(F.lit(""))
            .alias("v"),
        ),
    )


def _values(options: Column, *keys: str) -> Column:
    return F.transform(F.filter(options, lambda o: o["k"].isin(*keys)), lambda o: o["v"])


def _last(options: Column, *keys: str) -> Column:
    return F.try_element_at(_values(options, *keys), F.lit(-1))


def _last_int(options: Column, *keys: str) -> Column:
    return F.trim(_last(options, *keys)).try_cast("int")


def _unquote(text: Column) -> Column:
    return F.trim(text, F.lit('"'))


def _content(value: Column) -> Column:
    """struct<neg, text, mods> of a content option; NULL when it holds no closed quoted string."""
    negated = value.startswith("!")
    rest = F.when(negated, F.trim(F.substring(value, F.lit(2), F.length(value)))).otherwise(value)
    text = F.regexp_extract(rest, '^"([^"]*)"', 1)
    tail = F.regexp_replace(F.regexp_replace(rest, '^"[^"]*"', ""), "^[, ]+", "")
    return F.when(
        rest.rlike('^"[^"]*"'),
        F.struct(negated.alias("neg"), text.alias("text"), F.transform(F.split(tail, ","), lambda p: F.trim(p)).alias("mods")),
    )


def _sized_setting(options: Column, word: str) -> Column:
    """Values given to depth or offset, in order, by options and by the primary content's modifiers."""

    def from_option(o: Column) -> Column:
        by_option = F.when(o["k"] == word, F.array(F.trim(o["v"]).try_cast("int")))
        mods = F.filter(o["c"]["mods"], lambda m: m.startswith(word) & (F.size(F.split(m, r"\s+")) > 1))
        by_content = F.when(
            o["primary"], F.transform(mods, lambda m: F.element_at(F.split(m, r"\s+"), -1).try_cast("int"))
        )
        return F.coalesce(by_option, by_content, F.array().cast("array<int>"))

    seen = F.array_compact(F.flatten(F.transform(options, from_option)))
    return F.coalesce(F.try_element_at(seen, F.lit(-1)), F.lit(0))


def _detection_filter(value: Column) -> Column:
    pairs = F.filter(
        F.transform(F.split(value, ","), lambda p: F.split(F.trim(p), r"\s+")), lambda t: F.size(t) == 2
    )

    def setting(name: str) -> Column:
        named = F.filter(pairs, lambda t: F.lower(F.get(t, F.lit(0))) == name)
        return F.get(F.try_element_at(named, F.lit(-1)), F.lit(1))

    given = setting("track").isNotNull() | setting("count").isNotNull() | setting("seconds").isNotNull()
    return F.when(
        given,
        F.struct(
            setting("track").alias("track"),
            setting("count").try_cast("int").alias("count"),
            setting("seconds").try_cast("int").alias("seconds"),
            (setting("count").isNotNull() & setting("seconds").isNotNull()).alias("active"),
        ),
    )


def parse_rules(lines: DataFrame, variables: dict | None = None) -> DataFrame:
    """Rules from ``(line, text)`` rows. Comments and blanks are dropped; bad lines keep an ``error``."""
    variables = NETWORK_VARIABLES if variables is None else variables
    text = F.col("text")
    rows = lines.select("line", F.trim(F.regexp_replace("text", r"[\t\r]", " ")).alias("text")).where(
        (text != "") & ~text.startswith("#")
    )
    optioned = (
        F.lower(F.substring_index(text, " ", 1)).isin(RULE_ACTIONS)
        & F.contains(text, F.lit("("))
        & F.contains(text, F.lit(")"))
    )
    rows = rows.withColumn("kind", F.when(optioned, "snort").otherwise("simple"))
    rows = settled(_header_columns(rows))
    rows = settled(_option_columns(rows))
    snort = F.col("kind") == "snort"
    error = (
        F.when(snort & (F.size("__body") < 1), F.concat(F.lit("no protocol: "), text))
        .when(~snort & ~F.size("__tokens").isin(5, 6), F.concat(F.lit("unrecognised rule format: "), text))
        .when(~snort & (F.col("src_port").isNull() | F.col("dst_port").isNull()), F.lit("address without a port"))
    )
    parsed = settled(rows.withColumn("error", error))
    src, dst = address_terms(F.col("src_ip"), variables), address_terms(F.col("dst_ip"), variables)
    sport, dport = port_terms(F.col("src_port"), variables), port_terms(F.col("dst_port"), variables)
    return settled(
        parsed.withColumns(
            {
            "src_nets": src,
            "dst_nets": dst,
            "src_ports": sport,
            "dst_ports": dport,
            "src_spec": plain_port_spec(F.col("src_port")),
            "dst_spec": plain_port_spec(F.col("dst_port")),
            "flags_mask": required_bits(F.coalesce("flags", F.lit(""))),
            "rule_text": rule_text(),
            "label": F.when((F.col("kind") == "snort") & (F.col("msg") != ""), F.col("msg")).otherwise(rule_text()),
            "rule_pos": F.col("line"),
            }
        ).drop("__tokens", "__body", "__header", "__options", "__contents")
    )


def _header_columns(rows: DataFrame) -> DataFrame:
    text, snort = F.col("text"), F.col("kind") == "snort"
    tokens = F.split(text, " ")
    shift = F.when(F.size(tokens) == 6, 1).otherwise(0)
    rows = settled(rows.withColumn("__tokens", tokens).withColumn("__header", F.trim(F.substring_index(text, "(", 1))))
    words = F.split(F.col("__header"), r"\s+")
    rows = rows.withColumn("__body", F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))))
    rows = settled(rows)
    full = F.size("__body") >= 6

    def body(i: int) -> Column:
        return F.get("__body", F.lit(i))

    def token(i: int) -> Column:
        return F.get("__tokens", shift + i)

    def side(option_form: Column, simple_token: Column, part: int) -> Column:
        return F.when(snort, F.when(full, option_form).otherwise("any")).otherwise(
            F.get(F.split(simple_token, ":"), F.lit(part))
        )

    word = F.lower(body(0))
    transport = word.isin(TRANSPORTS)
    return rows.withColumns(
        {
            "action": F.when(snort, F.lower(F.substring_index("__header", " ", 1))),
            "src_ip": side(body(1), token(1), 0),
            "src_port": side(body(2), token(1), 1),
            "direction": F.when(snort, F.when(full, body(3)).otherwise("->")).otherwise(token(2)),
            "dst_ip": side(body(4), token(3), 0),
            "dst_port": side(body(5), token(3), 1),
            "payload": F.when(snort, "*").otherwise(token(4)),
            "proto": F.when(snort, F.when(transport, F.upper(word)).otherwise("IP")).otherwise(token(0)),
            "protocol": F.when(snort, F.when(transport, word).otherwise("ip")).otherwise(F.lower(token(0))),
            "service": F.when(snort & ~transport, word).otherwise(""),
            "sid": F.when(snort, "").when(F.size("__tokens") == 6, F.substring_index(F.get("__tokens", F.lit(0)), ":", 1)).otherwise(""),
        }
    )


def _option_columns(rows: DataFrame) -> DataFrame:
    text, snort = F.col("text"), F.col("kind") == "snort"
    open_at = F.instr(text, "(")
    close_at = F.length(text) - F.instr(F.reverse(text), ")") + 1
    block = F.when(snort, F.substring(text, open_at + 1, F.greatest(close_at - open_at - 1, F.lit(0)))).otherwise("")
    rows = settled(rows.withColumn("__options", _option_list(block)))
    options = F.col("__options")
    marked = F.transform(
        options,
        lambda o, i: F.struct(o["k"].alias("k"), o["v"].alias("v"), i.alias("i"), F.when(o["k"] == "content", _content(o["v"])).alias("c")),
    )
    rows = settled(rows.withColumn("__contents", marked))
    # The first positive, non-empty content is the pattern that is matched.
    positive = F.filter(
        "__contents", lambda o: o["c"].isNotNull() & ~o["c"]["neg"] & (o["c"]["text"] != "")
    )
    primary = F.get(F.transform(positive, lambda o: o["i"]), F.lit(0))
    rows = settled(rows.withColumn("__primary", primary))
    rows = rows.withColumn(
        "__contents",
        F.transform(
            "__contents",
            lambda o: F.struct(
                o["k"].alias("k"),
                o["v"].alias("v"),
                o["c"].alias("c"),
                F.coalesce(o["i"] == F.col("__primary"), F.lit(False)).alias("primary"),
            ),
        ),
    )
    rows = settled(rows.withColumn("__chosen", F.get(F.filter("__contents", lambda o: o["primary"]), F.lit(0))["c"]))
    chosen = F.col("__chosen")
    mods = F.coalesce(chosen["mods"], F.array().cast("array<string>"))
    flow = F.coalesce(_unquote(_last(options, "flow")), F.lit(""))
    return rows.withColumns(
        {
            "msg": F.coalesce(_unquote(_last(options, "msg")), F.lit("")),
            "sid": F.coalesce(_last(options, "sid"), F.col("sid")),
            "rev": F.coalesce(_last(options, "rev"), F.lit("")),
            "classtype": F.coalesce(_last(options, "classtype"), F.lit("")),
            "service": F.coalesce(F.trim(F.substring_index(_last(options, "service"), ",", 1)), F.col("service")),
            "flow": flow,
            "flow_options": F.transform(F.split(flow, ","), lambda p: F.trim(p)),
            "flags": F.coalesce(_unquote(F.trim(F.substring_index(_last(options, "flags"), ",", 1))), F.lit("")),
            "content": F.coalesce(chosen["text"], F.lit("")),
            "contents": F.transform(F.filter("__contents", lambda o: o["c"].isNotNull()), lambda o: o["c"]["text"]),
            "nocase": (F.size(_values(options, "nocase")) > 0) | F.array_contains(mods, "nocase"),
            "fast_pattern": (F.size(_values(options, "fast_pattern")) > 0) | F.array_contains(mods, "fast_pattern"),
            "depth": _sized_setting(F.col("__contents"), "depth"),
            "offset": _sized_setting(F.col("__contents"), "offset"),
            "pcre": F.coalesce(F.get(_values(options, "pcre"), F.lit(0)), F.lit("")),
            "itype": _last_int(options, "itype"),
            "icode": _last_int(options, "icode"),
            "icmp_id": _last_int(options, "icmp_id", "id"),
            "ip_proto": _last_int(options, "ip_proto"),
            "byte_test": F.coalesce(_last(options, "byte_test"), F.lit("")),
            "detection_filter": _detection_filter(F.coalesce(_last(options, "detection_filter"), F.lit(""))),
        }
    ).drop("__primary", "__chosen")


def rule_text() -> Column:
    """A rule written back in the positional form."""
    return F.concat_ws(
        " ",
        "proto",
        F.concat("src_ip", F.lit(":"), "src_port"),
        "direction",
        F.concat("dst_ip", F.lit(":"), "dst_port"),
        "payload",
    )


def rule_name() -> Column:
    return F.concat(F.lit("ruleID "), "sid")


# ---------------------------------------------------------------- files


def read_rule_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of every line. Rule files are small and are read whole, so numbers are exact."""
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_name"))
    return whole.select("file", F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), r"\r?\n"))).select(
        "file", (F.col("pos") + 1).alias("line"), F.col("col").alias("text")
    )


def load_rules(spark: SparkSession, path: str, variables: dict | None = None) -> DataFrame:
    return parse_rules(read_rule_lines(spark, path), variables)


def usable(rules: DataFrame) -> DataFrame:
    return rules.where(F.col("error").isNull())


def rejected(rules: DataFrame) -> DataFrame:
    return rules.where(F.col("error").isNotNull()).select("line", "text", "error")


def catalogue(lines: DataFrame) -> DataFrame:
    """Every line of the rule files with what it is."""
    text = F.trim(F.regexp_replace("text", r"[\t\r]", " "))
    return lines.withColumn("text", text).select(
        *lines.columns, F.col("text").startswith("#").alias("is_comment"), (F.col("text") == "").alias("is_empty")
    )


def verify_rules(lines: DataFrame, variables: dict | None = None) -> DataFrame:
    """Strict check of ``(line, text)`` rows: an empty or unparsable line is a problem row."""
    trimmed = lines.withColumn("text", F.trim("text"))
    empty = trimmed.where("text = ''").select("line", "text", F.concat(F.lit("Empty rule at position "), "line").alias("problem"))
    # A comment is not a rule either: it fails to parse.
    shielded = trimmed.where("text <> ''").withColumn("text", F.regexp_replace("text", "^#", "\u0001"))
    bad = rejected(parse_rules(shielded, variables)).select(
        "line",
        F.regexp_replace("text", "^\u0001", "#").alias("text"),
        F.concat(F.lit("Invalid rule at position "), "line").alias("problem"),
    )
    return empty.unionByName(bad)


def require_valid(lines: DataFrame, variables: dict | None = None) -> DataFrame:
    """The parsed rules; running it fails on the first problem row."""
    checked = verify_rules(lines, variables).groupBy().agg(F.min("problem").alias("problem"))
    gate = checked.select(F.assert_true(F.col("problem").isNull(), F.col("problem")).alias("__ok"))
    return parse_rules(lines, variables).crossJoin(F.broadcast(gate)).drop("__ok")


def both_directions(rules: DataFrame) -> DataFrame:
    """Rules with ``<>`` replaced by one ``->`` rule per direction."""
    forward = rules.withColumn("direction", F.when(F.col("direction") == "<>", "->").otherwise(F.col("direction")))
    turned = rules.where("direction = '<>'")
    swap = {"src_ip": "dst_ip", "src_port": "dst_port", "src_nets": "dst_nets", "src_ports": "dst_ports", "src_spec": "dst_spec"}
    swap = {**swap, **{b: a for a, b in swap.items()}}
    backward = turned.withColumn("direction", F.lit("->")).select(
        *[F.col(swap.get(c, c)).alias(c) for c in rules.columns]
    )
    return forward.withColumn("turned", F.lit(False)).unionByName(backward.withColumn("turned", F.lit(True)))
