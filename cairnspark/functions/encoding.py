"""Canonical encoding as column expressions: little-endian integers, counts before sequences, fields in order.

Everything is built from hexadecimal text, since byte functions of strings would read binary as UTF-8. Integers are
read as two's complement of their width. Functions of arrays are interpreted, and there a value is computed again
wherever it is named: such values are named once, or bound by ``_once``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def le(value: Column, width: int) -> Column:
    """An integer in ``width`` bytes, least first: its digits turned, after the two of each byte have changed places."""
    v, low = value.cast("bigint"), F.lit(0x0F0F0F0F0F0F0F0F)
    swapped = F.shiftleft(v.bitwiseAND(low), 4).bitwiseOR(F.shiftrightunsigned(v, 4).bitwiseAND(low))
    return F.unhex(F.rpad(F.reverse(F.hex(swapped)), 2 * width, "0"))


def u8(v: Column) -> Column:
    return le(v, 1)


def u16(v: Column) -> Column:
    return le(v, 2)


def u32(v: Column) -> Column:
    return le(v, 4)


def u64(v: Column) -> Column:
    """Also for i64 and time stamps."""
    return le(v, 8)


def fixed(v: Column, width: int) -> Column:
    """Bytes of a known length; any other length is an error."""
    return F.when(F.octet_length(v) == width, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {width} bytes, got "), F.octet_length(v).cast("string"))))


def blob(v: Column) -> Column:
    return F.concat(u32(F.octet_length(v)), v)


def text(v: Column) -> Column:
    return F.concat(u32(F.octet_length(v)), F.encode(v, "UTF-8"))


def sequence(v: Column, item) -> Column:
    """An array: its count, then each item as ``item`` encodes it; null if an item encodes to null."""
    return _once(v, lambda a: F.concat(u32(F.size(a)), _joined(F.transform(a, item))))


def _joined(parts: Column) -> Column:
    """The bytes of an array of binaries, in time linear in them; null if one is (no digit stands for it)."""
    return F.unhex(F.array_join(F.transform(parts, F.hex), "", "null"))


def _twice(keys: Column) -> Column:
    """A key comes more than once. Text is compared by hash, binaries would be compared each with each."""
    return F.size(F.array_distinct(F.transform(keys, F.hex))) < F.size(keys)


def option(v: Column, item) -> Column:
    return F.when(v.isNull(), F.lit(b"\x00")).otherwise(F.concat(F.lit(b"\x01"), item(v)))


def sorted_map(v: Column, key, value) -> Column:
    """A map, its entries in order of their encoded keys; keys that encode alike are an error."""
    pairs = F.sort_array(F.transform(F.map_entries(v), lambda e: F.struct(key(e["key"]).alias("k"), value(e["value"]).alias("v"))))
    body = lambda ps: F.when(_twice(F.transform(ps, lambda p: p["k"])), F.raise_error(F.lit("duplicate map key")).cast("binary")).otherwise(sequence(ps, lambda p: F.concat(p["k"], p["v"])))
    return _once(pairs, body)


def read_le(v: Column, at: Column | int, width: int) -> Column:
    """The unsigned integer at a byte offset, as bigint; null where the bytes run out (8 bytes wrap to signed)."""
    at = F.lit(at) if isinstance(at, int) else at
    # a character for each byte, so that they can be turned
    turned = F.encode(F.reverse(F.decode(F.substring(v, (at + 1).try_cast("int"), F.lit(width)), "ISO-8859-1")), "ISO-8859-1")
    return F.when(F.octet_length(v) >= at + width, F.conv(F.hex(turned), 16, -10).cast("bigint"))


# Composite records, each from a struct column with the named fields.


def commitment(c: Column) -> Column:
    return F.concat(fixed(c["merkle_root"], 32), u64(c["size"]), u32(c["block_size"]), u32(c["block_count"]))


def chunk_ref(c: Column) -> Column:
    return F.concat(fixed(c["chunk_id"], 32), fixed(c["ciphertext_hash"], 32), commitment(c["commitment"]), u64(c["offset"]), u32(c["size"]))


def leaf_node(c: Column) -> Column:
    return F.concat(u32(F.lit(0)), chunk_ref(c))


def internal_node(children: Column) -> Column:
    return F.concat(u32(F.lit(1)), sequence(children, lambda x: fixed(x, 32)))


def entry_node(name: Column, mode: Column, mtime: Column, content: Column) -> Column:
    return F.concat(u32(F.lit(2)), text(name), u32(mode), u64(mtime), fixed(content, 32))


def manifest_body(c: Column) -> Column:
    return F.concat(u32(c["crypto_version"]), fixed(c["object_id"], 32), u64(c["revision"]), fixed(c["content_root"], 32), u64(c["created_at"]), u64(c["modified_at"]), fixed(c["origin"]["public_key"], 32), fixed(c["origin"]["node_id"], 32))


def manifest(c: Column) -> Column:
    return F.concat(manifest_body(c["body"]), fixed(c["signature"], 64))


def lease_body(c: Column) -> Column:
    return F.concat(fixed(c["chunk_id"], 32), fixed(c["ciphertext_hash"], 32), commitment(c["commitment"]), fixed(c["holder"], 32), fixed(c["issuer"], 32), u64(c["issued_at"]), u64(c["expires_at"]))


def lease(c: Column) -> Column:
    return F.concat(lease_body(c["body"]), fixed(c["issuer_signature"], 64), fixed(c["holder_signature"], 64))


def node_body(c: Column) -> Column:
    return F.concat(fixed(c["node_id"], 32), u64(c["timestamp"]), sequence(c["addresses"], text), u64(c["services"]), fixed(c["public_key"], 32))


def node_announcement(c: Column) -> Column:
    return F.concat(node_body(c), fixed(c["signature"], 64))


def manifest_announcement(object_id: Column, signed: Column) -> Column:
    return F.concat(fixed(object_id, 32), manifest(signed))


def chunk_locator(chunk_id: Column, ciphertext_hash: Column) -> Column:
    return F.concat(fixed(chunk_id, 32), fixed(ciphertext_hash, 32))


def holders(leases: Column) -> Column:
    """A holder set from an array of leases: in order of their holders; a holder that comes twice is an error."""
    pairs = F.sort_array(F.transform(leases, lambda x: F.struct(fixed(x["body"]["holder"], 32).alias("k"), lease(x).alias("v"))))
    body = lambda ps: F.when(_twice(F.transform(ps, lambda p: p["k"])), F.raise_error(F.lit("a holder comes twice")).cast("binary")).otherwise(sequence(ps, lambda p: F.concat(p["k"], p["v"])))
    return _once(pairs, body)


def record_body(tag: Column, body: Column) -> Column:
    """Of a node (0), a manifest (1) or a holder set (2)."""
    return F.concat(u32(F.when(tag.isin(0, 1, 2), tag).otherwise(F.raise_error(F.lit("unknown kind of record")).try_cast("int"))), body)


def record(encoded_body: Column, mac: Column) -> Column:
    return F.concat(encoded_body, fixed(mac, 32))


def node_info(c: Column) -> Column:
    return F.concat(fixed(c["node_id"], 32), sequence(c["addresses"], text), fixed(c["public_key"], 32))


def find_value_result(found: Column, nodes: Column) -> Column:
    """An encoded record where there is one, else the nearer nodes (array of structs)."""
    return F.when(found.isNotNull(), F.concat(u8(F.lit(0)), found)).otherwise(F.concat(u8(F.lit(1)), sequence(nodes, node_info)))


def blob_metadata(root: Column, size: Column, chunks: Column) -> Column:
    return F.concat(fixed(root, 32), u64(size), u32(chunks))


def stored_chunk(nonce: Column, ciphertext: Column) -> Column:
    """The raw form, over which hashes are taken."""
    return F.concat(fixed(nonce, 24), ciphertext)


def parse_stored_chunk(raw: Column) -> Column:
    """struct(nonce, ciphertext, tag, plaintext_size) of the raw form; null under 40 bytes."""
    n = F.octet_length(raw)
    return F.when(n >= 40, F.struct(F.substring(raw, 1, 24).alias("nonce"), F.substring(raw, F.lit(25), n - 40).alias("ciphertext"), F.substring(raw, n - 15, F.lit(16)).alias("tag"), (n - 40).cast("bigint").alias("plaintext_size")))


# Decoding of fixed layouts. Bytes that are missing give null, and so do bytes that are left over.


def _whole(v: Column, width: int, value: Column) -> Column:
    return F.when(F.octet_length(v) == width, value)


def _part(v: Column, at: int, width: int) -> Column:
    return F.substring(v, at + 1, width)


def parse_commitment(v: Column, at: int = 0) -> Column:
    return F.struct(_part(v, at, 32).alias("merkle_root"), read_le(v, at + 32, 8).alias("size"), read_le(v, at + 40, 4).alias("block_size"), read_le(v, at + 44, 4).alias("block_count"))


def parse_chunk_ref(v: Column, at: int = 0) -> Column:
    value = F.struct(_part(v, at, 32).alias("chunk_id"), _part(v, at + 32, 32).alias("ciphertext_hash"), parse_commitment(v, at + 64).alias("commitment"), read_le(v, at + 112, 8).alias("offset"), read_le(v, at + 120, 4).alias("size"))
    return _whole(v, at + 124, value)


def parse_internal(v: Column) -> Column:
    """array<binary> of children of an encoded internal node."""
    n = read_le(v, 4, 4)
    good = (read_le(v, 0, 4) == 1) & (F.octet_length(v) == 8 + 32 * n)
    # as many as there are bytes for, whatever count a broken node claims
    there = F.greatest(F.floor((F.octet_length(v) - 8) / 32), F.lit(1).cast("bigint"))
    children = F.transform(F.sequence(F.lit(0).cast("bigint"), there - 1), lambda i: F.substring(v, (9 + 32 * i).try_cast("int"), F.lit(32)))
    return F.when(good, F.when(n == 0, F.array().cast("array<binary>")).otherwise(children))


def parse_node(v: Column) -> Column:
    """struct(kind, chunk, children) of an encoded tree node; null for an unknown kind or a wrong length."""
    kind = read_le(v, 0, 4).try_cast("int")
    return F.when(kind.isin(0, 1), F.struct(kind.alias("kind"), F.when(kind == 0, parse_chunk_ref(v, 4)).alias("chunk"), F.when(kind == 1, parse_internal(v)).alias("children")))


def parse_manifest_body(v: Column) -> Column:
    origin = F.struct(_part(v, 92, 32).alias("public_key"), _part(v, 124, 32).alias("node_id"))
    value = F.struct(read_le(v, 0, 4).try_cast("int").alias("crypto_version"), _part(v, 4, 32).alias("object_id"), read_le(v, 36, 8).alias("revision"), _part(v, 44, 32).alias("content_root"), read_le(v, 76, 8).alias("created_at"), read_le(v, 84, 8).alias("modified_at"), origin.alias("origin"))
    return F.when(read_le(v, 0, 4) == 1, _whole(v, 156, value))


def _lease_body(v: Column) -> Column:
    return F.struct(_part(v, 0, 32).alias("chunk_id"), _part(v, 32, 32).alias("ciphertext_hash"), parse_commitment(v, 64).alias("commitment"), _part(v, 112, 32).alias("holder"), _part(v, 144, 32).alias("issuer"), read_le(v, 176, 8).alias("issued_at"), read_le(v, 184, 8).alias("expires_at"))


def parse_lease_body(v: Column) -> Column:
    return _whole(v, 192, _lease_body(v))


def parse_blob_metadata(v: Column) -> Column:
    return _whole(v, 44, F.struct(_part(v, 0, 32).alias("root"), read_le(v, 32, 8).alias("size"), read_le(v, 40, 4).try_cast("int").alias("chunk_count")))


def _reader(at: Column, items: Column) -> Column:
    """State of reading a list: where the next item starts (null once the bytes do not fit), and what was read."""
    return F.struct(at.cast("bigint").alias("at"), items.alias("items"))


def _times(v: Column, at: Column, least: int) -> Column:
    """Numbers for as many items as a count at ``at`` claims, but no more than there are bytes for, each of ``least``."""
    n, room = read_le(v, at, 4), F.floor((F.octet_length(v) - at) / least)
    return F.when(n <= room, F.filter(F.sequence(F.lit(0).cast("bigint"), n), lambda i: i > 0))


def read_texts(v: Column, at: Column) -> Column:
    """struct(at, items): a sequence of texts at ``at``, and where it ends; ``at`` is null if bytes are missing."""
    start = _reader(at + 4, F.array().cast("array<string>"))

    def step(state: Column, _: Column) -> Column:
        size, begin = read_le(v, state["at"], 4), state["at"] + 4
        part = F.decode(F.substring(v, (begin + 1).try_cast("int"), size.try_cast("int")), "UTF-8")
        end = F.when(begin + size <= F.octet_length(v), begin + size)
        return _reader(end, F.concat(state["items"], F.array(part)))

    return F.aggregate(_times(v, at, 4), start, step)


def _read_info(v: Column, at: Column) -> Column:
    """struct(at, node): one node info at ``at``."""
    return _once(read_texts(v, at + 32), lambda t: F.struct(F.when(t["at"] + 32 <= F.octet_length(v), t["at"] + 32).alias("at"), F.struct(F.substring(v, (at + 1).try_cast("int"), F.lit(32)).alias("node_id"), t["items"].alias("addresses"), F.substring(v, (t["at"] + 1).try_cast("int"), F.lit(32)).alias("public_key")).alias("node")))


def _once(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_node_info(v: Column) -> Column:
    return _once(_read_info(v, F.lit(0).cast("bigint")), lambda r: F.when(r["at"] == F.octet_length(v), r["node"]))


def parse_node_infos(v: Column, at: int = 0) -> Column:
    """array of node infos: a sequence from byte ``at`` to the end; null if it does not end there."""
    start = _reader(F.lit(at + 4), F.array().cast("array<struct<node_id:binary,addresses:array<string>,public_key:binary>>"))
    step = lambda s, _: _once(_read_info(v, s["at"]), lambda r: _reader(r["at"], F.concat(s["items"], F.array(r["node"]))))
    return _once(F.aggregate(_times(v, F.lit(at).cast("bigint"), 68), start, step), lambda r: F.when(r["at"] == F.octet_length(v), r["items"]))


def parse_find_value(v: Column) -> Column:
    """struct(record, nodes): one of them; null for another tag."""
    tag = read_le(v, 0, 1)
    nodes = F.when(tag == 1, parse_node_infos(v, 1))
    rest = F.when(tag == 0, F.substring(v, F.lit(2), F.octet_length(v)))
    return F.when(rest.isNotNull() | nodes.isNotNull(), F.struct(rest.alias("record"), nodes.alias("nodes")))


def parse_node_announcement(v: Column) -> Column:
    """struct(node_id, timestamp, addresses, services, public_key, signature)."""

    def made(t: Column) -> Column:
        part = lambda after, width: F.substring(v, (t["at"] + after + 1).try_cast("int"), F.lit(width))
        value = F.struct(_part(v, 0, 32).alias("node_id"), read_le(v, 32, 8).alias("timestamp"), t["items"].alias("addresses"), read_le(v, t["at"], 8).alias("services"), part(8, 32).alias("public_key"), part(40, 64).alias("signature"))
        return F.when(t["at"] + 104 == F.octet_length(v), value)

    return _once(read_texts(v, F.lit(40).cast("bigint")), made)


def parse_entry_node(v: Column) -> Column:
    """struct(name, mode, mtime, content) of an encoded directory entry; null for another kind or a wrong length."""
    n = read_le(v, 4, 4)
    value = F.struct(F.decode(F.substring(v, F.lit(9), n.try_cast("int")), "UTF-8").alias("name"), read_le(v, 8 + n, 4).alias("mode"), read_le(v, 12 + n, 8).alias("mtime"), F.substring(v, (21 + n).try_cast("int"), F.lit(32)).alias("content"))
    return F.when((read_le(v, 0, 4) == 2) & (F.octet_length(v) == 52 + n), value)


#: Bytes of an encoded lease, and of an entry of a holder set.
_LEASE, _HOLDER = 320, 352


def parse_lease(v: Column, at: Column | int = 0) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    part = lambda a, n: F.substring(v, (at + a + 1).try_cast("int"), F.lit(n))
    return _once(part(0, _LEASE), lambda x: F.when(F.octet_length(x) == _LEASE, F.struct(_lease_body(x).alias("body"), F.substring(x, 193, 64).alias("issuer_signature"), F.substring(x, 257, 64).alias("holder_signature"))))


def parse_holders(v: Column) -> Column:
    """array<struct(holder, lease)> of an encoded holder set; null unless holders ascend strictly and no byte is left."""
    each = lambda x, f: F.transform(_times(x, F.lit(0).cast("bigint"), _HOLDER), f)
    holder = lambda x, i: F.substring(x, (5 + (i - 1) * _HOLDER).try_cast("int"), F.lit(32))
    ascend = lambda keys: keys == F.sort_array(F.array_distinct(keys))
    items = lambda x: each(x, lambda i: F.struct(holder(x, i).alias("holder"), parse_lease(x, 36 + (i - 1) * _HOLDER).alias("lease")))
    # leases are read once the holders are in order
    return _once(v, lambda x: F.when((F.octet_length(x) == 4 + read_le(x, 0, 4) * _HOLDER) & _once(each(x, lambda i: F.hex(holder(x, i))), ascend), items(x)))


def parse_record(v: Column) -> Column:
    """struct(kind, body, encoded, mac): ``encoded`` is what the mac is over; null for an unknown kind or too few bytes."""
    kind, n = read_le(v, 0, 4).try_cast("int"), F.octet_length(v)
    return F.when(kind.isin(0, 1, 2) & (n >= 36), F.struct(kind.alias("kind"), F.substring(v, F.lit(5), n - 36).alias("body"), F.substring(v, F.lit(1), n - 32).alias("encoded"), F.substring(v, n - 31, F.lit(32)).alias("mac")))


def parse_sequence(v: Column, width: int) -> Column:
    """array<binary> of items of one width; null unless the bytes are exactly those."""
    n = read_le(v, 0, 4)
    return F.when(F.octet_length(v) == 4 + n * width, F.transform(_times(v, F.lit(0).cast("bigint"), width), lambda i: F.substring(v, (5 + (i - 1) * width).try_cast("int"), F.lit(width))))


def plaintext_size(ciphertext: Column) -> Column:
    """Of a ciphertext with its tag; 0 for one that is shorter than a tag."""
    return F.greatest(F.octet_length(ciphertext) - 16, F.lit(0)).cast("bigint")
