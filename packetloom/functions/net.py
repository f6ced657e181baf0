"""Address, port and TCP-flag expressions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, functions as F

SYN, ACK, RST, FIN, PSH, URG = 0x02, 0x10, 0x04, 0x01, 0x08, 0x20

# Flag letters of option rules and the bit each one requires.
FLAG_BITS = {"S": SYN, "A": ACK, "F": FIN, "R": RST, "P": PSH, "U": URG}

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_PATTERN = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def ipv4_to_long(ip: Column) -> Column:
    """Dotted quad to a number; NULL for anything that is not a valid IPv4 address."""
    part = F.split(ip, r"\.")
    value = F.lit(0).cast("long")
    for i in range(4):
        value = value * 256 + F.get(part, F.lit(i)).try_cast("long")
    return F.when(ip.rlike(IPV4_PATTERN), value)


def cidr_bounds(cidr: str) -> tuple[int, int]:
    """First and last address of a network; host bits may be set."""
    net = ipaddress.ip_network(cidr, strict=False)
    return int(net.network_address), int(net.broadcast_address)


def in_cidr(ip: Column, cidr: str) -> Column:
    lo, hi = cidr_bounds(cidr)
    return F.coalesce(ipv4_to_long(ip).between(lo, hi), F.lit(False))


def is_multicast_or_broadcast(ip: Column) -> Column:
    return (ip == "255.255.255.255") | in_cidr(ip, "224.0.0.0/4")


def has_flag(flags: Column, bit: int) -> Column:
    return F.coalesce(flags.bitwiseAND(bit) != 0, F.lit(False))


def required_bits(letters: Column) -> Column:
    """Bit mask of every known letter in a flag string; other characters are ignored."""
    text = F.upper(letters)
    mask = F.lit(0)
    for letter, bit in FLAG_BITS.items():
        mask = mask + F.when(text.contains(letter), bit).otherwise(0)
    return mask


def flags_satisfied(flags: Column, mask: Column) -> Column:
    return flags.bitwiseAND(mask) == mask


def is_tcp() -> Column:
    return F.col("tcp_flags").isNotNull()


def is_udp() -> Column:
    return (F.coalesce(F.col("ip_proto"), F.lit(-1)) == 17) & F.col("src_port").isNotNull()


def is_icmp() -> Column:
    return F.col("icmp_type").isNotNull()


def is_ip() -> Column:
    return F.col("ip_proto").isNotNull()


def is_syn_only() -> Column:
    return has_flag(F.col("tcp_flags"), SYN) & ~has_flag(F.col("tcp_flags"), ACK)


def protocol_label(arp: Column, tcp: Column, udp: Column, icmp: Column, sport: Column, dport: Column) -> Column:
    """Application label from the layers present and the well-known ports, destination port first."""

    def by_port(port: Column) -> Column:
        return (
            F.when(port == 80, "HTTP")
            .when(port == 443, "TLS")
            .when(port == 22, "SSH")
            .when(port.isin(20, 21), "FTP")
            .when(port.isin(25, 587), "SMTP")
        )

    return (
        F.when(arp, "ARP")
        .when(tcp, F.coalesce(by_port(dport), by_port(sport), F.lit("TCP")))
        .when(udp, F.when((dport == 53) | (sport == 53), "DNS").otherwise("UDP"))
        .when(icmp, "ICMP")
        .otherwise("OTHER")
    )


def flow_protocol(number: Column) -> Column:
    return F.when(number == 6, "TCP").when(number == 17, "UDP").otherwise("Other")
