"""The scalar library, by group: every function on columns of the test tables."""

from __future__ import annotations

import zlib

from .base import table

#: The checksums of the five kinds of events, in hexadecimal, for SQL that has no such function.
_CRC = " ".join(f"WHEN '{k}' THEN '{zlib.crc32(k.encode()):x}'" for k in ("click", "error", "purchase", "signup", "view"))
#: Group: table, its key, a rule's prelude of aliases, then (result, call, SQL).
GROUPS = {
    "fn_string": (
        "part",
        "p_partkey",
        [
            ("concat_", "concat(p_name, '-', p_size, '/', p_brand)", "p_name || '-' || p_size || '/' || p_brand"),
            ("endswith_", "endswith(p_name, 'ing')", "ends_with(p_name, 'ing')"),
            ("startswith_", "startswith(p_name, 'red')", "starts_with(p_name, 'red')"),
            ("indexof_", "indexof(p_name, 'e')", "(instr(p_name, 'e') - 1)::BIGINT"),
            ("length_", "length(p_name)", "length(p_name)"),
            ("lower_", "lower(p_type)", "lower(p_type)"),
            ("upper_", "upper(p_name)", "upper(p_name)"),
            ("lpad_", "lpad(p_type, 3)", "'   ' || p_type"),
            ("rpad_", "rpad(p_type, 2)", "p_type || '  '"),
            ("ltrim_", "ltrim(concat('  ', p_type, ' '))", "p_type || ' '"),
            ("rtrim_", "rtrim(concat(' ', p_type, '\t '))", "' ' || p_type"),
            ("trim_", "trim(concat(' \t', p_type, ' '))", "p_type"),
            ("numbytes_", "numbytes(concat(p_name, 'é'))", "(length(p_name) + 2)::BIGINT"),
            ("regexp_matches_", "regexp_matches(p_brand, '#1[0-9]')", "regexp_matches(p_brand, '#1[0-9]')"),
            ("regexp_replace_", "regexp_replace(p_brand, '[0-9]+', 'x')", "regexp_replace(p_brand, '[0-9]+', 'x', 'g')"),
            ("regexp_substr_", "regexp_substr(p_name, 'b[a-z]+')", "regexp_extract(p_name, 'b[a-z]+')"),
            ("reverse_", "reverse(p_name)", "reverse(p_name)"),
            ("substring_", "substring(p_name, 2, 5)", "substring(p_name, 3, 3)"),
            ("substring_rest", "substring(p_name, 4)", "substring(p_name, 5)"),
            ("split_first", "split_value(p_name, ' ', 0)", "split_part(p_name, ' ', 1)"),
            ("split_last", "split_value(p_name, ' ', -1)", "split_part(p_name, ' ', -1)"),
            ("format_", "format(p_retailprice, 1)", "printf('%.1f', p_retailprice)"),
            ("format_en", "format(p_retailprice * 1000, 2, 'en_US')", "format('{:,.2f}', p_retailprice * 1000)"),
        ],
    ),
    "fn_string_null": (
        "events",
        "event_id",
        [
            ("s", "CASE WHEN event_type = 'click' THEN event_type END", "CASE WHEN event_type = 'click' THEN event_type END"),
            ("a", "concat(s, '!')", "coalesce(CASE WHEN event_type = 'click' THEN event_type END, '') || '!'"),
            ("b", "startswith(s, 'c')", "event_type = 'click'"),
            ("c", "length(s)", "CASE WHEN event_type = 'click' THEN 5 ELSE 0 END::BIGINT"),
            ("d", "lower(s)", "CASE WHEN event_type = 'click' THEN 'click' END"),
            ("e", "indexof(s, 'x')", "(-1)::BIGINT"),
            ("f", "isnull(s)", "event_type <> 'click'"),
            ("g", "coalesce(s, 'none')", "CASE WHEN event_type = 'click' THEN event_type ELSE 'none' END"),
            ("h", "regexp_matches(s, 'l')", "event_type = 'click'"),
        ],
    ),
    "fn_math": (
        "events",
        "event_id",
        [
            ("abs_", "abs(value - 20)", "abs(value - 20)"),
            ("abs_int", "abs(user_id - 75)", "abs(user_id - 75)"),
            ("acos_", "round(acos(value / 10), 9)", "CASE WHEN value <= 10 THEN round(acos(value / 10), 9) END"),
            ("asin_", "round(asin(value / 10), 9)", "CASE WHEN value <= 10 THEN round(asin(value / 10), 9) END"),
            ("atan_", "round(atan(value), 9)", "round(atan(value), 9)"),
            ("atan2_", "round(atan2(value, user_id + 1), 9)", "round(atan2(value, user_id + 1), 9)"),
            ("bitand_", "bitand(user_id, 6)", "user_id & 6"),
            ("bitor_", "bitor(user_id, 6)", "user_id | 6"),
            ("bitxor_", "bitxor(user_id, 6)", "xor(user_id, 6)"),
            ("bitnot_", "bitnot(user_id)", "~user_id"),
            ("ceil_", "ceil(value)", "ceil(value)"),
            ("ceiling_", "ceiling(user_id)", "user_id::DOUBLE"),
            ("cos_", "round(cos(value), 9)", "round(cos(value), 9)"),
            ("cosh_", "round(cosh(value / 100), 9)", "round(cosh(value / 100), 9)"),
            ("exp_", "round(exp(value / 100), 9)", "round(exp(value / 100), 9)"),
            ("floor_", "floor(value)", "floor(value)"),
            ("ln_", "round(ln(value + 1), 9)", "round(ln(value + 1), 9)"),
            ("log_", "round(log(value + 1), 9)", "round(log10(value + 1), 9)"),
            ("log_base", "round(log(2, value + 1), 9)", "round(ln(value + 1) / ln(2), 9)"),
            ("mod_", "mod(user_id, 7)", "(user_id % 7)::DOUBLE"),
            ("pi_", "pi()", "pi()"),
            ("power_", "round(power(value, 2), 4)", "round(power(value, 2), 4)"),
            ("pow_", "pow(user_id, 2)", "power(user_id, 2)"),
            ("round_", "round(value / 3)", "round(value / 3)"),
            ("round_digits", "round(value / 3, 3)", "round(value / 3, 3)"),
            ("trunc_", "trunc(value / 3, 3)", "round(value / 3, 3)"),
            ("sign_", "sign(value - 20)", "sign(value - 20)::BIGINT"),
            ("sin_", "round(sin(value), 9)", "round(sin(value), 9)"),
            ("sinh_", "round(sinh(value / 100), 9)", "round(sinh(value / 100), 9)"),
            ("sqrt_", "round(sqrt(value), 9)", "round(sqrt(value), 9)"),
            ("tan_", "round(tan(value / 1000), 9)", "round(tan(value / 1000), 9)"),
            ("tanh_", "round(tanh(value / 100), 9)", "round(tanh(value / 100), 9)"),
            ("cot_", "round(cot(value / 1000 + 1), 9)", "round(cot(value / 1000 + 1), 9)"),
            ("radians_", "round(radians(value), 9)", "round(radians(value), 9)"),
            ("degrees_", "round(degrees(value), 6)", "round(degrees(value), 6)"),
            ("conv_", "conv(user_id, 10, 16)", "to_hex(user_id)"),
        ],
    ),
    "fn_conversion": (
        "events",
        "event_id",
        [
            ("to_text", "cast(user_id, 'string')", "user_id::VARCHAR"),
            ("to_float", "cast(concat(user_id, '.5'), 'float')", "user_id + 0.5::DOUBLE"),
            ("to_int", "cast(value, 'bigint')", "trunc(value)::BIGINT"),
            ("text_to_int", "cast(concat(user_id, ''), 'bigint')", "user_id"),
            ("bad_text", "cast(event_type, 'bigint')", "NULL::BIGINT"),
            ("to_bool", "cast(CASE WHEN user_id > 75 THEN 'true' ELSE 'false' END, 'boolean')", "user_id > 75"),
            ("time_millis", "to_seconds(cast(event_time(), 'datetime'))", "epoch_us(ts) // 1000000"),
            ("chr_", "chr(event_type)", "ascii(event_type)"),
            ("encode_", "encode(event_type, 'base64')", "to_base64(event_type::BLOB)"),
            ("decode_", "cast(decode(encode(event_type, 'base64'), 'base64'), 'string')", "event_type"),
            ("md5_", "md5(event_type)", "md5(event_type)"),
            ("sha1_", "sha1(event_type)", "sha1(event_type)"),
            ("sha256_", "sha256(event_type)", "sha256(event_type)"),
            ("hex2dec_", "hex2dec('0x1F')", "31::BIGINT"),
            ("dec2hex_", "dec2hex(user_id)", "'0x' || lower(to_hex(user_id))"),
            ("to_json_", "to_json(event_type)", "'\"' || event_type || '\"'"),
            ("bypass_", "bypass(value)", "value"),
            ("props_", "props('site')", "'north'"),
            ("rule_", "rule_id()", "NULL::VARCHAR"),
            ("path", "json_path_query(props, '$.k')", "json_extract_string(props, '$.k')"),
            ("path_first", "json_path_query_first(props, '$.k')", "json_extract_string(props, '$.k')"),
            ("path_exists", "json_path_exists(props, '$.k')", "true"),
            ("path_missing", "json_path_exists(props, '$.z')", "false"),
            ("keyed", "get_keyed_state(event_type, 'bigint', 7)", "7::BIGINT"),
            ("zip_", "cast(decompress(compress(event_type, 'zlib'), 'zlib'), 'string')", "event_type"),
            ("gzip_", "cast(decompress(compress(event_type, 'gzip'), 'gzip'), 'string')", "event_type"),
            ("flate_", "cast(decompress(compress(event_type, 'flate'), 'flate'), 'string')", "event_type"),
        ],
    ),
    "fn_time": (
        "events",
        "event_id",
        [
            ("day_", "day(ts)", "day(ts)"),
            ("day_of_month_", "day_of_month(ts)", "day(ts)"),
            ("day_of_week_", "day_of_week(ts)", "dayofweek(ts)"),
            ("day_of_year_", "day_of_year(ts)", "dayofyear(ts)"),
            ("hour_", "hour(ts)", "hour(ts)"),
            ("minute_", "minute(ts)", "minute(ts)"),
            ("month_", "month(ts)", "month(ts)"),
            ("second_", "second(ts)", "second(ts)"),
            ("microsecond_", "microsecond(ts)", "(epoch_us(ts) % 1000000)"),
            ("day_name_", "day_name(ts)", "dayname(ts)"),
            ("month_name_", "month_name(ts)", "monthname(ts)"),
            ("last_day_", "last_day(ts)", "strftime(last_day(ts), '%Y-%m-%d')"),
            ("format_time_", "format_time(ts, 'yyyy/MM/dd HH:mm:ss')", "strftime(ts, '%Y/%m/%d %H:%M:%S')"),
            ("date_calc_", "date_calc(ts, '-1h30m')", "strftime(ts - INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S')"),
            ("date_diff_", "date_diff(ts, 1706745600000)", "(1706745600000000 - epoch_us(ts)) * 1000"),
            ("from_days_", "from_days(user_id)", "CASE WHEN user_id <> 0 THEN strftime(DATE '1970-01-01' + (user_id - 1)::INT, '%Y-%m-%d') END"),
            ("from_unix_time_", "from_unix_time(user_id * 1000)", "CASE WHEN user_id <> 0 THEN strftime(make_timestamp(user_id * 1000000000), '%Y-%m-%d %H:%M:%S') END"),
            ("to_seconds_", "to_seconds(ts)", "epoch_us(ts) // 1000000"),
            ("convert_tz_", "format_time(convert_tz(ts, 'Asia/Tokyo'), 'yyyy-MM-dd HH')", "strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H')"),
            ("event_time_", "event_time()", "epoch_us(ts) // 1000"),
        ],
    ),
    "fn_array": (
        "events",
        "event_id",
        [
            ("created", "array_create(user_id, 2, user_id, 5)", "[user_id, 2, user_id, 5]"),
            ("position_", "array_position(created, 5)", "(list_position([user_id, 2, user_id, 5], 5) - 1)::BIGINT"),
            ("missing", "array_position(created, -7)", "(-1)::BIGINT"),
            ("last_position", "array_last_position(created, user_id)", "CASE WHEN user_id = 5 THEN 3 ELSE 2 END::BIGINT"),
            ("element", "element_at(created, 1)", "2::BIGINT"),
            ("element_back", "element_at(created, -1)", "5::BIGINT"),
            ("contains_", "array_contains(created, 9)", "list_contains([user_id, 2, user_id, 5], 9)"),
            ("contains_any", "array_contains_any(created, array_create(7, 8))", "user_id IN (7, 8)"),
            ("removed", "array_remove(created, 2)", "list_filter([user_id, 2, user_id, 5], lambda x: x <> 2)"),
            ("intersect_", "array_intersect(created, array_create(5, 2, 99))", "CASE WHEN user_id = 99 THEN [5, 2, 99] ELSE [5, 2] END::BIGINT[]"),
            ("union_", "array_union(created, array_create(2, 1000))", "CASE WHEN user_id IN (2, 5) THEN CASE user_id WHEN 2 THEN [2, 5, 1000] ELSE [5, 2, 1000] END ELSE [user_id, 2, 5, 1000] END::BIGINT[]"),
            ("max_", "array_max(created)", "greatest(user_id, 5)"),
            ("min_", "array_min(created)", "least(user_id, 2)"),
            ("except_", "array_except(created, array_create(2, 5))", "CASE WHEN user_id IN (2, 5) THEN [] ELSE [user_id] END::BIGINT[]"),
            ("repeated", "repeat(user_id, 3)", "[user_id, user_id, user_id]"),
            ("sequence_", "sequence(1, 9, 4)", "[1, 5, 9]::BIGINT[]"),
            ("cardinality_", "cardinality(created)", "4::BIGINT"),
            ("array_cardinality_", "array_cardinality(created)", "4::BIGINT"),
            ("flat", "array_flatten(array_create(created, array_create(1)))", "[user_id, 2, user_id, 5, 1]"),
            ("distinct_", "array_distinct(created)", "CASE user_id WHEN 2 THEN [2, 5] WHEN 5 THEN [5, 2] ELSE [user_id, 2, 5] END::BIGINT[]"),
            ("mapped", "array_map('abs', array_create(user_id - 75, -1))", "[abs(user_id - 75), 1]"),
            ("joined", "array_join(array_create('a', event_type, 'b'), '|')", "'a|' || event_type || '|b'"),
            ("sorted", "array_sort(array_create(10, 9, 111))", "[10, 111, 9]::BIGINT[]"),
            ("concat_", "array_concat(created, created)", "[user_id, 2, user_id, 5, user_id, 2, user_id, 5]"),
            ("shuffled", "cardinality(array_shuffle(created))", "4::BIGINT"),
        ],
    ),
    "fn_object": (
        "events",
        "event_id",
        [
            ("o", "object_construct('a', user_id, 'b', event_id)", "MAP {'a': user_id, 'b': event_id}"),
            ("keys_", "array_join(array_sort(keys(o)), ',')", "'a,b'"),
            ("values_", "array_max(values(o))", "greatest(user_id, event_id)"),
            ("made", "object(array_create('x', 'y'), array_create(1, user_id))->y", "user_id"),
            ("zipped", "zip(array_create(array_create('k', event_type)))->k", "event_type"),
            ("items_", "cardinality(items(o))", "2::BIGINT"),
            ("joined", "object_concat(o, object_construct('b', 1, 'c', 2))->b", "1::BIGINT"),
            ("joined_size", "object_size(object_concat(o, object_construct('b', 1, 'c', 2)))", "3::BIGINT"),
            ("erased", "object_size(erase(o, 'a'))", "1::BIGINT"),
            ("picked", "object_pick(o, 'a')->a", "user_id"),
            ("pairs", "cardinality(obj_to_kvpair_array(o))", "2::BIGINT"),
            ("back", "kvpair_array_to_obj(obj_to_kvpair_array(o))->b", "event_id"),
            ("element", "element_at(o, 'b')", "event_id"),
            ("json_", "to_json(o)", "'{\"a\":' || user_id || ',\"b\":' || event_id || '}'"),
        ],
    ),
}
ROWS = []
for _name, (_table, _key, _calls) in GROUPS.items():
    _rule = f"SELECT {_key}, " + ", ".join(f"{call} AS {label}" for label, call, _ in _calls) + f" FROM {_table}"
    _sql = f"SELECT {_key}, " + ", ".join(f"{sql} AS {label}" for label, _, sql in _calls) + f" FROM {_table}"
    ROWS.append((_name, _rule, _sql))
#: What differs on every run, by what always holds.
ROWS += [
    ("fn_now", "SELECT event_id, length(now()) = 19 AND length(current_timestamp()) = 19 AND length(local_time()) = 19 AND length(local_timestamp()) = 19 AND length(now(3)) = 23 AS a, length(cur_date()) = 10 AND length(current_date()) = 10 AS b, length(cur_time()) = 8 AND length(current_time()) = 8 AS c, tstamp() > event_time() AS d, rule_start() > 0 AS e FROM events", "SELECT event_id, true AS a, true AS b, true AS c, true AS d, true AS e FROM events"),
    ("fn_random", "SELECT event_id, rand() < 1 AS a, length(newuuid()) AS b, delay(1, value) AS c FROM events", "SELECT event_id, true AS a, 36::BIGINT AS b, value AS c FROM events"),
    ("fn_hash", "SELECT event_id, crc32(event_type) AS c, length(sha384(event_type)) AS a, length(sha512(event_type)) AS b FROM events", f"SELECT event_id, CASE event_type {_CRC} END AS c, 96 AS a, 128 AS b FROM events"),
    ("fn_digests", "SELECT event_id, md5(event_type) AS m, sha1(event_type) AS s, sha256(event_type) AS t FROM events", "SELECT event_id, md5(event_type) AS m, sha1(event_type) AS s, sha256(event_type) AS t FROM events"),
    ("fn_meta", "SELECT event_id, isnull(meta('topic')) AS a, isnull(mqtt('topic')) AS b FROM events", "SELECT event_id, true AS a, true AS b FROM events"),
    ("fn_parse_json", "SELECT event_id, cast(parse_json(props), 'string') AS j FROM events", "SELECT event_id, replace(props, ' ', '') AS j FROM events"),
]
QUERIES, ORACLE_SQL = table(ROWS)
