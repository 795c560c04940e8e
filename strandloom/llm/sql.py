"""Shared pieces of DuckDB SQL for the operators' reference queries."""

_STEP = "case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
#: Tables for a WITH clause: crc_table.t holds the 256 steps of CRC-32.
CRC_TABLES = "t0 as (select i, i as c from range(256) r(i)), " + ", ".join(f"t{j + 1} as (select i, {_STEP} as c from t{j})" for j in range(8)) + ", crc_table as (select list(c order by i) as t from t8)"
#: The unsigned CRC-32 of the UTF-8 bytes of {x}, a name or expression, where crc_table is joined.
CRC = (
    "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, octet_length(encode({x}))), lambda i: ('0x' || substr(hex(encode({x})), 2 * i::int + 1, 2))::bigint)), "
    "lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"
)
