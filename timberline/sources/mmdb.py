"""Reader of the MaxMind DB file format, from its public description: a binary trie over address bits, and typed records."""

from __future__ import annotations

import ipaddress
import struct

_MARK = b"\xab\xcd\xefMaxMind.com"


class Database:
    """An open file's content; ``find`` gives an address' record or None, for IPv4 and IPv6 alike."""

    def __init__(self, content: bytes) -> None:
        self.content = content
        at = content.rfind(_MARK)
        if at < 0:
            raise ValueError("not a MaxMind DB file")
        self.base = at + len(_MARK)
        meta, _ = self._value(self.base, self.base)
        self.nodes, self.bits, self.version = meta["node_count"], meta["record_size"], meta["ip_version"]
        if self.bits not in (24, 28, 32):
            raise ValueError(f"unknown record size {self.bits}")
        self.data = self.nodes * self.bits // 4 + 16
        self.four = 0
        if self.version == 6:
            for _ in range(96):
                if self.four >= self.nodes:
                    break
                self.four = self._child(self.four, 0)

    def _child(self, node: int, bit: int) -> int:
        size = self.bits // 4
        raw = self.content[node * size : (node + 1) * size]
        if self.bits == 28:
            middle = raw[3]
            return ((middle >> 4) << 24 | int.from_bytes(raw[:3], "big")) if not bit else ((middle & 15) << 24 | int.from_bytes(raw[4:], "big"))
        half = size // 2
        return int.from_bytes(raw[half * bit : half * (bit + 1)], "big")

    def find(self, address: str) -> object | None:
        try:
            ip = ipaddress.ip_address(address)
        except ValueError:
            return None
        if ip.version == 6 and ip.ipv4_mapped is not None:
            ip = ip.ipv4_mapped
        if ip.version == 6 and self.version == 4:
            return None
        node, width, number = (self.four if ip.version == 4 else 0), ip.max_prefixlen, int(ip)
        for i in range(width - 1, -1, -1):
            if node >= self.nodes:
                break
            node = self._child(node, number >> i & 1)
        if node <= self.nodes:
            return None
        return self._value(node - self.nodes - 16 + self.data, self.data)[0]

    def _value(self, at: int, base: int) -> tuple[object, int]:
        """The value at an offset and where the next one begins; pointers count from base."""
        b = self.content
        head = b[at]
        at += 1
        kind = head >> 5
        if kind == 1:
            size = head >> 3 & 3
            raw = int.from_bytes(b[at : at + size + 1], "big")
            low = head & 7
            to = raw if size == 3 else (low << 8 * (size + 1) | raw) + (0, 2048, 526336)[size]
            return self._value(base + to, base)[0], at + size + 1
        if kind == 0:
            kind = b[at] + 7
            at += 1
        size = head & 31
        if size > 28:
            more = size - 28
            size = int.from_bytes(b[at : at + more], "big") + (29, 285, 65821)[more - 1]
            at += more
        if kind == 7:
            out = {}
            for _ in range(size):
                key, at = self._value(at, base)
                out[key], at = self._value(at, base)
            return out, at
        if kind == 11:
            items = []
            for _ in range(size):
                item, at = self._value(at, base)
                items.append(item)
            return items, at
        if kind == 14:
            return bool(size), at
        raw, at = b[at : at + size], at + size
        match kind:
            case 2:
                return raw.decode("utf-8", "replace"), at
            case 3:
                return struct.unpack(">d", raw)[0], at
            case 15:
                return struct.unpack(">f", raw)[0], at
            case 8:
                return int.from_bytes(raw.rjust(4, b"\0") if len(raw) < 4 else raw, "big", signed=True), at
            case 5 | 6 | 9 | 10:
                return int.from_bytes(raw, "big"), at
        return raw, at


def city(record: dict) -> dict[str, str]:
    """country, city, subdivision, latitude, longitude, timezone, accuracy_radius, as far as known."""
    place, name = record.get("location") or {}, lambda x: ((x or {}).get("names") or {}).get("en")
    divisions = record.get("subdivisions") or [None]
    out = {"country": (record.get("country") or {}).get("iso_code"), "city": name(record.get("city")), "subdivision": name(divisions[0]) or (divisions[0] or {}).get("iso_code"), "timezone": place.get("time_zone")}
    if place.get("latitude") or place.get("longitude"):
        out |= {"latitude": format(place["latitude"], ".4f"), "longitude": format(place["longitude"], ".4f")}
    if place.get("accuracy_radius"):
        out["accuracy_radius"] = str(place["accuracy_radius"])
    return {k: v for k, v in out.items() if v}


def asn(record: dict) -> dict[str, str]:
    """asn (AS and its number) and as_org."""
    number, org = record.get("autonomous_system_number"), record.get("autonomous_system_organization")
    return {k: v for k, v in (("asn", f"AS{number}" if number else None), ("as_org", org)) if v}
