"""DuckDB SQL of the registered queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

READS = """
genome as (select g, string_agg(translate(md5('g' || g || '-' || i), '0123456789abcdef', 'ACGTACGTACGTACGT'), '' order by i) as bases from range(64) a(g), range(16) b(i) group by g),
d0 as (select o_orderkey as k, o_custkey as c, substr(bases, (o_orderkey * 37) % 400 + 1, 100) as s, substr(bases, (o_orderkey * 37 + 150) % 400 + 1, 100) as m from orders join genome on o_custkey % 64 = g),
d1 as (select * replace (case when k % 7 = 0 then substr(s, 1, (k * 13) % 100) || translate(substr(s, (k * 13) % 100 + 1, 1), 'ACGT', 'CATG') || substr(s, (k * 13) % 100 + 2) else s end as s,
    case when k % 61 = 0 then substr(m, 1, (k * 17) % 100) || 'N' || substr(m, (k * 17) % 100 + 2) else m end as m) from d0),
d2 as (select * replace (case when k % 499 = 0 then repeat('N', 40) || substr(s, 41) when k % 53 = 0 then substr(s, 1, (k * 29) % 100) || 'N' || substr(s, (k * 29) % 100 + 2) else s end as s) from d1),
pairs as (select k as read_id, '@RUN7.' || (k + 1) || ' L' || (c % 4 + 1) || ':' || (k % 1000) || '/1' as head,
    case when k % 2 = 1 then reverse(translate(s, 'ACGTN', 'TGCAN')) else s end as seq,
    substr(translate(md5('q' || k || '-0') || md5('q' || k || '-1') || md5('q' || k || '-2') || md5('q' || k || '-3'), '0123456789abcdef', '#,/27:<=?@ACEFHI'), 1, 100) as qua,
    case when k % 2 = 1 then m else reverse(translate(m, 'ACGTN', 'TGCAN')) end as mate_seq,
    substr(translate(md5('p' || k || '-0') || md5('p' || k || '-1') || md5('p' || k || '-2') || md5('p' || k || '-3'), '0123456789abcdef', '#,/27:<=?@ACEFHI'), 1, 100) as mate_qua,
    '@RUN7.' || (k + 1) || ' L' || (c % 4 + 1) || ':' || (k % 1000) || '/2' as mate_head from d2),
reads as (select read_id, head, seq, qua from pairs)"""

VALID = "(instr({x}, 'N') = 0 and {x} not like 'AAA%' and {x} not like 'AAC%' and instr(substr({x}, 2), 'AA') = 0)"


def code(x: str) -> str:
    terms = " + ".join(f"(instr('ACGT', substr({x}, {i + 1}, 1)) - 1) * {4 ** (7 - i)}" for i in range(8))
    return f"(case when {x} is null or instr({x}, 'N') > 0 then 65536 else {terms} end)::int"


def rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGTN', 'TGCAN'))"


def best(name: str, source: str, skip: int = 0, also: str = "true") -> str:
    """CTE: per read_id the smallest valid k-mer over rows (read_id, o, s), smaller o first on ties."""
    return f"""{name} as (select read_id, o, p, kmer from (select *, row_number() over (partition by read_id order by kmer, o, p) as n from
    (select *, substr(s, p + 1, 8) as kmer from ({source}) x, range(0, 200) t(p) where p < length(s) - 8 - {skip} and len(s) - len(replace(s, 'N', '')) < len(s) // 3) y
    where {VALID.format(x="kmer")} and {also}) z where n = 1)"""


def binned(skip: int = 0) -> str:
    source = f"select read_id, 0 as o, seq as s from reads union all select read_id, 1, {rc('seq')} from reads"
    return f"""{READS}, {best("m", source, skip)},
binned as (select r.read_id, r.head, {code("m.kmer")} as signature, coalesce(m.kmer, 'NNNNNNNN') as sig_text, coalesce(m.p, 0)::int as minim_pos, coalesce(m.o = 1, false) as is_rev,
    case when m.o = 1 then {rc("r.seq")} else r.seq end as seq, case when m.o = 1 then reverse(r.qua) else r.qua end as qua from reads r left join m using (read_id))"""


B = binned()
SIZED = f"{B}, sizes as (select signature, count(*) as bin_size from binned group by signature), sized as (select * from binned join sizes using (signature))"
LZ = """
dup as (select signature, seq, minim_pos, min(read_id) as read_id, count(*) as n_copies from binned where signature <> 65536 group by all),
srt as (select *, row_number() over (partition by signature order by substr(seq, minim_pos + 1), reverse(substr(seq, 1, minim_pos + 1)), read_id) as rank from dup),
cand as (select a.read_id, a.signature, a.rank, b.read_id as other, b.rank as brank, b.minim_pos - a.minim_pos as shift, length(a.seq) as len,
    greatest(a.minim_pos - b.minim_pos, 0) as ao, greatest(b.minim_pos - a.minim_pos, 0) as bo, a.seq as aseq, b.seq as bseq
    from srt a join srt b on a.signature = b.signature and b.rank between a.rank - 7 and a.rank - 1),
cost as (select *, abs(shift) + 2 * hamming(substr(aseq, ao + 1, least(length(aseq) - ao, length(bseq) - bo)), substr(bseq, bo + 1, least(length(aseq) - ao, length(bseq) - bo))) as cost from cand where abs(shift) <= 127),
pick as (select * from (select *, row_number() over (partition by read_id order by cost, brank desc) as n from cost) x where n = 1 and cost <= len // 2),
nodes as (select s.read_id, s.signature, s.rank::int as rank, case when p.read_id is null then 'HARD' else 'LZ' end as node_type, p.other as parent_id, p.shift::int as shift, p.cost::int as cost,
    coalesce(p.cost = abs(p.shift), false) as no_mismatch from srt s left join pick p using (read_id))"""
N = f"{B}, {LZ}"


def put(name: str, ctes: str, select: str, recursive: bool = False) -> None:
    ORACLE[name] = f"with {'recursive ' * recursive}{ctes}\n{select}"


put("bin_stats", B, "select signature, sig_text, count(*) as n_reads, sum(is_rev::int)::bigint as n_reverse, sum(length(seq))::bigint as raw_dna, min(minim_pos) as min_pos, max(minim_pos) as max_pos from binned group by signature, sig_text")
put("reads_scan", READS, "select * from reads")
put("reads_project", READS, "select read_id, seq from reads")
put("header_trim", READS, "select read_id, split_part(head, ' ', 1) as head from reads")
put("revcomp_se", READS, f"select read_id, {rc('seq')} as seq, reverse(qua) as qua from reads")
put("revcomp_pe", READS, f"select read_id, {rc('mate_seq')} as seq, reverse(mate_qua) as qua, {rc('seq')} as mate_seq, reverse(qua) as mate_qua from pairs")
put("mate_swap", READS, "select read_id, mate_seq as seq, mate_qua as qua, seq as mate_seq, qua as mate_qua from pairs")
KM = f"{READS}, km as (select distinct substr(seq, p + 1, 8) as kmer from reads, range(0, 93) t(p)), coded as (select kmer, {code('kmer')} as code from km)"
put("kmer_codes", KM, "select kmer, code from coded")
put("signature_text", KM, "select code, case when code = 65536 then 'NNNNNNNN' else min(kmer) end as text from coded group by code")
put("signature_revcomp", KM, f"select distinct code, case when code = 65536 then 65536 else {code(rc('kmer'))} end::int as rc_code from coded")
put("signature_validity", KM, f"select kmer, {VALID.format(x='kmer')} as valid from km")
NS = "len(seq) - len(replace(seq, 'N', ''))"
put("n_filter", READS, f"select read_id, ({NS})::int as n from reads where {NS} >= length(seq) // 3")
put("plain_dna", READS, "select read_id from reads where seq not like '%N%'")
put("lowq_signature_filter", B, "select read_id from binned where signature <> 65536 and list_min(list_transform(range(1, 9), lambda i: ascii(substr(qua, minim_pos + i::int, 1)))) >= 39")
for _name, _skip in (("minimizer_se", 0), ("minimizer_skip10", 10)):
    put(_name, binned(_skip), "select read_id, signature, sig_text, minim_pos, is_rev from binned")
PE = f"""{READS}, {best("m", f"select read_id, 0 as o, {rc('seq')} as s from pairs union all select read_id, 1, {rc('mate_seq')} from pairs union all select read_id, 2, mate_seq from pairs union all select read_id, 3, seq from pairs")}"""
put(
    "minimizer_pe",
    PE,
    f"""select read_id, {code("m.kmer")} as signature, coalesce(p, 0)::int as minim_pos, coalesce(o < 2, false) as is_rev, coalesce(o in (0, 2), false) as is_swapped,
    case o when 0 then {rc("seq")} when 1 then {rc("mate_seq")} when 2 then mate_seq else seq end as seq,
    case o when 0 then {rc("mate_seq")} when 1 then {rc("seq")} when 2 then seq else mate_seq end as mate_seq from pairs left join m using (read_id)""",
)
put("orientation_restore", READS, "select read_id, seq, qua from reads")
put("orientation_restore_pe", READS, "select read_id, seq, qua, mate_seq, mate_qua from pairs")
put("bin_len_minmax", B, "select signature, min(length(seq))::int as min_len, max(length(seq))::int as max_len from binned group by signature")
put("bin_filter_min", SIZED, "select read_id, signature, bin_size from sized where bin_size >= 64 and signature <> 65536")
put(
    "small_bins_to_n",
    SIZED,
    "select s.read_id, case when small then 65536 else signature end::int as signature, case when small then 0 else minim_pos end as minim_pos, is_rev and not small as is_rev, case when small then r.seq else s.seq end as seq from (select *, bin_size < 8 and signature <> 65536 as small from sized) s join reads r using (read_id)",
)
put("small_and_n_union", SIZED, "select read_id, r.seq from sized s join reads r using (read_id) where bin_size < 64 or signature = 65536")
put("base_freq", READS, "select unnest(string_split(seq, '')) as base, count(*) as cnt from reads group by 1")
SYM = f"{READS}, sym as (select i - 1 as col, case when i = 1 then -1 else ascii(substr(qua, i::int - 1, 1)) - 33 end as prev, ascii(substr(qua, i::int, 1)) - 33 as cur from reads, range(1, 101) t(i) where i <= length(qua))"
put("qual_freq", SYM, "select cur::int as q, count(*) as cnt from sym group by cur")
put("qual_cond_counts", SYM, "select col::int as col, prev::int as prev, cur::int as cur, count(*) as cnt from sym group by all")
PROB = f"{SYM}, prob as (select col::int as col, cur::int as q, count(*) / sum(count(*)) over (partition by col) as p from sym group by col, cur)"
put("qual_marginal", PROB, "select col, q, p::double as p from prob")
put("qual_entropy", PROB, "select col, round(-sum(p * log2(p)), 6)::double as bits from prob group by col")
LEVEL = "case when q <= 1 then 0 when q <= 9 then 6 when q <= 19 then 15 when q <= 24 then 22 when q <= 29 then 27 when q <= 34 then 33 when q <= 39 then 37 else 40 end"


def mapped(rule: str, offset: int = 33, out: int = 33, column: str = "qua") -> str:
    return f"list_aggregate(list_transform(list_transform(string_split({column}, ''), lambda x: ascii(x) - {offset}), lambda q: chr({rule} + {out})), 'string_agg', '')"


put("qual_binary", READS, f"select read_id, {mapped('(case when q >= 20 then 40 else 6 end)')} as qua from reads")
put("qual_illumina8", READS, f"select read_id, {mapped('(' + LEVEL + ')')} as qua from reads")
put(
    "qual_nmask",
    READS,
    "select read_id, list_aggregate(list_transform(range(1, length(seq) + 1), lambda i: case when substr(seq, i::int, 1) = 'N' then '''' when ascii(substr(qua, i::int, 1)) >= 53 then 'I' else '''' end), 'string_agg', '') as qua from reads",
)
put("qual_phred64_to_33", READS, f"select read_id, {mapped('q', 33, 64)} as qua64, qua from reads")
put(
    "qual_mean_distortion",
    f"{SYM}, dist as (select q - ({LEVEL}) as d from (select cur as q from sym) x)",
    "select round(avg(abs(d)), 6) as l1, round(avg(d * d), 6) as mse, round(avg(log2(1 + abs(d))), 6) as lorentz from dist",
)
TOK = f"""{READS}, tok as (select read_id, i::int as field, toks[i + 1] as token, coalesce(seps[i + 1], '') as separator from
    (select read_id, regexp_split_to_array(head, '[ ./:#+]') as toks, regexp_extract_all(head, '[ ./:#+]') as seps from reads) x, range(0, 50) t(i) where i < len(toks)),
prof as (select field, bool_and(regexp_matches(token, '^(0|[1-9][0-9]{{0,17}})$')) as is_numeric, count(distinct token) = 1 as is_const, min(separator) as separator, count(distinct token) as n_values,
    min(try_cast(token as bigint)) as lo, max(try_cast(token as bigint)) as hi from tok group by field)"""
put("header_tokens", TOK, "select read_id, field, token, separator from tok")
put("header_profile", TOK, "select field, is_numeric, is_const, separator, case when is_numeric then lo end as min_val, case when is_numeric then hi end as max_val, n_values from prof")
put("header_pe_field", TOK.replace("regexp_extract_all(head, '[ ./:#+]') as seps from reads)", "regexp_extract_all(head, '[ ./:#+]') as seps from (select read_id, head from pairs union all select read_id, mate_head from pairs) h)"), "select coalesce(max(field), 0)::int as pe_field from prof where is_numeric and lo = 1 and hi = 2")
put(
    "header_encode",
    TOK,
    "select read_id, field, case when is_numeric then token::bigint - lo else dense_rank() over (partition by field order by token) - 1 end as code from tok join prof using (field) where not is_const".replace("token::bigint", "try_cast(token as bigint)"),
)
put("header_roundtrip", READS, "select read_id, head from reads")
put("header_auto", B, "select read_id, '@' || sig_text || '.' || row_number() over (partition by signature order by read_id) as head from binned")
put("header_mate", READS, "select read_id, mate_head as head from pairs")
put("fastq_lines", READS, "select head || chr(10) || seq || chr(10) || '+' || chr(10) || qua as value from reads")
for _name in ("fastq_files", "fastq_stream"):
    put(_name, READS, "select head, seq, qua from reads")
put("fastq_pair_files", READS, "select head, seq, qua, mate_seq, mate_qua from pairs")
put(
    "fastq_damaged",
    READS,
    """select unnest(case when read_id % 97 <> 0 then [head] else [head, seq, qua] end) as head, case when read_id % 97 <> 0 then seq end as seq, case when read_id % 97 <> 0 then qua end as qua from reads""",
)
put("fastq_qualities", READS, "select qua as value from reads")
put("contig_members_sound", READS, "select read_id as contig_id, read_id as n_wrong from reads where false")
put(
    "stream_sizes",
    N.replace("a.rank - 7 and", "a.rank - 255 and").replace("binned as (select r.read_id", "binned0 as (select r.read_id").replace("from reads r left join m using (read_id))", """from reads r left join m using (read_id)),
    binned as (select * replace (case when small then 65536 else signature end as signature, case when small then 0 else minim_pos end as minim_pos, case when small and is_rev then reverse(translate(seq, 'ACGTN', 'TGCAN')) else seq end as seq)
    from (select *, signature <> 65536 and count(*) over (partition by signature) < 8 as small from binned0))"""),
    """select stream, sum(n)::bigint as symbols from (select 'root bases' as stream, length(s.seq) - 7 as n from nodes join srt s using (read_id) where node_type = 'HARD'
    union all select 'child bases', length(c.aseq) - least(length(c.aseq) - c.ao, length(c.bseq) - c.bo) from nodes n join cost c on c.read_id = n.read_id and c.other = n.parent_id
    union all select 'child mismatches', (cost - abs(shift)) // 2 from nodes where node_type = 'LZ'
    union all select 'names', length(head) from binned where signature <> 65536 union all select 'qualities', length(qua) from binned where signature <> 65536
    union all select 'raw bases', length(seq) from binned where signature = 65536) group by stream""",
)
put("read_sort_rank", B, "select read_id, signature, row_number() over (partition by signature order by substr(seq, minim_pos + 1), reverse(substr(seq, 1, minim_pos + 1)), read_id)::int as rank from binned")
put("duplicates", B, "select signature, seq, minim_pos, min(read_id) as read_id, count(*) as n_copies from binned group by signature, seq, minim_pos")
put("dedup_reads", B, "select min(read_id) as read_id from binned group by signature, seq, minim_pos")
NODE = "select read_id, signature, rank, node_type, parent_id, shift, cost, no_mismatch from nodes"
put("lz_match_w8", N, NODE)
put("lz_match_w255", N.replace("a.rank - 7 and", "a.rank - 254 and"), NODE)
put("lz_cost_hist", N, "select cost as key, count(*) as cnt from nodes where node_type = 'LZ' group by 1")
put("lz_shift_hist", N, "select shift as key, count(*) as cnt from nodes where node_type = 'LZ' group by 1")
put("lz_parent_distance", N, "select a.read_id, (a.rank - b.rank - 1)::int as lz_id from nodes a join nodes b on a.parent_id = b.read_id and a.signature = b.signature")
put("lz_mismatch_hist", N, "select ((cost - abs(shift)) // 2)::int as key, count(*) as cnt from nodes where node_type = 'LZ' group by 1")
put("lz_expensive", N, "select read_id, ((cost - abs(shift)) // 2)::int as mismatches, (cost - abs(shift)) // 2 > 4 as is_expensive from nodes where node_type = 'LZ'")
TREE = f"{N}, walk as (select read_id, read_id as root_id, 0 as depth from nodes where node_type = 'HARD' union all select n.read_id, w.root_id, w.depth + 1 from nodes n join walk w on n.parent_id = w.read_id)"
put("forest_depth", TREE, "select read_id, root_id, depth from walk", True)
put("tree_size", TREE, "select root_id, count(*) as size, max(depth) as max_depth from walk group by root_id", True)
for _p in (2, 4, 8):
    put(f"rebin_eligible_p{_p}", B, f"select read_id, signature from binned where signature <> 65536 and signature % {_p} <> 0 and signature % {_p // 2} = 0")
TARGET = f"""{B}, el as (select * from binned where signature <> 65536 and signature % 2 <> 0),
{best("tm", f"select read_id, 0 as o, seq as s, sig_text from el union all select read_id, 1, {rc('seq')}, sig_text from el", 0, "substr(kmer, 8, 1) in ('A', 'G') and kmer <> sig_text")},
goes as (select read_id, signature, case when kmer is not null then {code("kmer")} end::int as new_signature, p::int as new_pos, coalesce(o = 1, false) as flips from el left join tm using (read_id))"""
put("rebin_target_single", TARGET, "select read_id, signature, new_signature, new_pos, flips from goes")
put(
    "rebin_diff",
    f"{TARGET}, i as (select signature, count(*) as n_in from goes group by 1), o as (select coalesce(new_signature, signature) as signature, count(*) as n_out from goes group by 1)",
    "select coalesce(i.signature, o.signature) as signature, coalesce(n_in, 0) as n_in, coalesce(n_out, 0) as n_out, coalesce(n_out, 0) - coalesce(n_in, 0) as diff from i full join o on i.signature = o.signature",
)
COLS = f"{B}, cols as (select signature, (i - minim_pos)::int as col, substr(seq, i::int + 1, 1) as base, count(*) as cnt from binned, range(0, 100) t(i) where signature <> 65536 group by all)"
put("contig_vote", COLS, "select signature, col, base from (select *, row_number() over (partition by signature, col order by cnt desc, instr('AGCTN', base)) as n from cols) x where n = 1")
put("contig_variants", COLS, "select signature, col, sum(cnt)::bigint as depth, (sum(cnt) - max(cnt))::bigint as n_variant from cols group by signature, col having sum(cnt) > max(cnt)")
put("mate_zip_join", READS, "select read_id, head, seq, qua, mate_seq, mate_qua from pairs")
put("qual_replace_join", READS, f"select read_id, head, seq, {mapped('(' + LEVEL + ')')} as qua from reads")
put(
    "signature_diff",
    f"""{READS}, sg as (select distinct read_id, w, substr(s, p + 1, 8) as x from (select read_id, 1 as w, seq as s from pairs union all select read_id, 2, mate_seq from pairs) y, range(0, 92) t(p)),
ok as (select * from sg where {VALID.format(x="x")})""",
    "select p.read_id, count(a.x)::int as only_mate from pairs p left join (select * from ok where w = 2) a on a.read_id = p.read_id and not exists (select 1 from ok b where b.read_id = a.read_id and b.w = 1 and b.x = a.x) group by p.read_id",
)
put("alphabet_union", READS, "select distinct unnest(string_split(qua || mate_qua, '')) as symbol from pairs")
put("top_signatures", B, "select signature, count(*) as bin_size from binned group by 1 order by bin_size desc, signature limit 4")
put(
    "match_rle",
    f"""{N}, fl as (select n.read_id, (i - 1)::int as place, substr(a.seq, greatest(-shift, 0) + i::int, 1) = substr(b.seq, greatest(shift, 0) + i::int, 1) as is_match
    from nodes n join srt a on a.read_id = n.read_id join srt b on b.read_id = n.parent_id, range(1, 101) t(i) where i <= least(length(a.seq) - greatest(-shift, 0), length(b.seq) - greatest(shift, 0))),
g as (select *, place - row_number() over (partition by read_id, is_match order by place) as g from fl)""",
    "select read_id, min(place) as start, is_match, count(*) as n from g group by read_id, is_match, g",
)
put("archive_roundtrip_lossless", READS, "select read_id, head, seq, qua from reads")
put("archive_roundtrip_fast", READS, "select read_id, head, seq, qua from reads")
EIGHT = "list_aggregate(list_transform(range(1, length(seq) + 1), lambda i: case when substr(seq, i::int, 1) = 'N' then '!' else chr((" + LEVEL.replace("q <=", "ascii(substr(qua, i::int, 1)) - 33 <=") + ") + 33) end), 'string_agg', '')"
put("archive_roundtrip_reduced", READS, f"select read_id, split_part(head, ' ', 1) as head, seq, {EIGHT} as qua from reads")
put("archive_roundtrip_max", READS, "select read_id, '@' as head, seq, list_aggregate(list_transform(range(1, length(seq) + 1), lambda i: case when substr(seq, i::int, 1) = 'N' then '''' when ascii(substr(qua, i::int, 1)) >= 53 then 'I' else '''' end), 'string_agg', '') as qua from reads")
put(
    "qual_divergence",
    f"{PROB}, whole as (select cur::int as q, count(*) / sum(count(*)) over () as p0 from sym group by cur)",
    "select col, round(sum(p * log2(p / p0)), 6)::double as kl from prob join whole using (q) group by col",
)
put("whole_logs", READS, "select read_id, (length(read_id::varchar) - 1)::int as log10, length(bin(read_id))::int as bits from reads where read_id > 0")
put("records_head", READS, "select * from reads order by read_id limit 100")
put("records_shuffled", READS, "select * from reads")
put("position_steps", B, "select read_id, minim_pos - lag(minim_pos, 1, 0) over (partition by signature order by minim_pos, read_id) as step from binned")
put("bins_allowed", B, "select read_id, signature from binned where signature in (select signature from binned group by signature having count(*) >= 8)")
put(
    "rebin_target_allowed",
    TARGET.replace("kmer <> sig_text", f"kmer <> sig_text and {code('kmer')} in (select signature from binned group by signature having count(*) >= 40)"),
    "select read_id, signature, new_signature, new_pos, flips from goes",
)
BITS = "round((lgamma(sum(c) + 32.0) - lgamma(32.0) - sum(lgamma(c + 0.5) - lgamma(0.5))) / ln(2), 2)::double as bits"
put("qual_adaptive_bits", f"{SYM}, cc as (select prev::int as prev, cur, count(*) as c from sym group by prev, cur)", f"select prev, sum(c)::bigint as n, {BITS} from cc group by prev")
put("qual_position_bits", f"{SYM}, cc as (select (col * 8 // 100)::int as part, prev::int as prev, cur, count(*) as c from sym group by all)", f"select part, prev, sum(c)::bigint as n, {BITS} from cc group by part, prev")
put(
    "rle0",
    f"""{N}, dist as (select a.signature, a.rank, (a.rank - b.rank - 1)::int as s from nodes a join nodes b on a.parent_id = b.read_id and a.signature = b.signature),
runs as (select *, row_number() over (partition by signature order by rank) - row_number() over (partition by signature, s = 0 order by rank) as g from dist),
coded as (select signature, min(rank) as rank, count(*) as n, repeat('00', (count(*) // 2)::int) || case when count(*) % 2 = 1 then '01' else '' end as x from runs where s = 0 group by signature, g
    union all select signature, rank, 1, printf('%02X', s + 1) from runs where s > 0)""",
    "select signature, sum(n)::bigint as n_symbols, string_agg(x, '' order by rank) as stream from coded group by signature",
)
put(
    "lz_prefix_search",
    f"""{N.replace("a.rank - 7 and", "a.rank - 2 and")},
pre as (select signature, read_id, rank, seq, minim_pos, substr(seq, minim_pos - 1, 2) as pair, reverse(substr(seq, 1, minim_pos - 1)) || '~' as prefix from srt where minim_pos >= 8),
near as (select x.read_id, y.read_id as other, y.prefix >= x.prefix as up, y.minim_pos - x.minim_pos as shift, length(x.seq) // 2 as most,
    row_number() over (partition by x.read_id, y.prefix >= x.prefix order by case when y.prefix >= x.prefix then y.prefix end, case when y.prefix >= x.prefix then y.rank end, y.prefix desc, y.rank desc) as far,
    greatest(x.minim_pos - y.minim_pos, 0) as ao, greatest(y.minim_pos - x.minim_pos, 0) as bo, x.seq as aseq, y.seq as bseq
    from pre x join nodes n on n.read_id = x.read_id and n.node_type = 'HARD' join pre y on y.signature = x.signature and y.pair = x.pair and y.rank < x.rank),
priced as (select *, abs(shift) + 2 * hamming(substr(aseq, ao + 1, least(length(aseq) - ao, length(bseq) - bo)), substr(bseq, bo + 1, least(length(aseq) - ao, length(bseq) - bo))) as price from near where far <= 5),
won as (select * from (select *, row_number() over (partition by read_id order by price, up, far) as n from priced where abs(shift) <= 127) z where n = 1 and price < most)""",
    "select n.read_id, signature, rank, case when w.read_id is null then node_type else 'LZ' end as node_type, coalesce(w.other, parent_id) as parent_id, coalesce(w.shift, n.shift)::int as shift, coalesce(w.price, cost)::int as cost, case when w.read_id is null then no_mismatch else w.price = abs(w.shift) end as no_mismatch from nodes n left join won w using (read_id)",
)
put(
    "mate_number_join",
    READS,
    """select coalesce(a.read_id, b.read_id) + 1 as number, coalesce(a.head, b.mate_head) as head, a.seq, a.qua, b.mate_seq, b.mate_qua, case when a.seq is null then 'no mate 1' when b.mate_seq is null then 'no mate 2' end as bad
    from (select * from pairs where read_id % 13 <> 5) a full join (select * from pairs where read_id % 11 <> 3) b on a.read_id = b.read_id""",
)
MATE_EIGHT = EIGHT.replace("qua", "mate_qua").replace("seq", "mate_seq")
BINARY = "list_aggregate(list_transform(range(1, length(seq) + 1), lambda i: case when substr(seq, i::int, 1) = 'N' then '\'\'' when ascii(substr(qua, i::int, 1)) >= 53 then 'I' else '\'\'' end), 'string_agg', '')"
MATE_BINARY = BINARY.replace("qua", "mate_qua").replace("seq", "mate_seq")
for _name in ("lossless", "reduced", "max"):
    ORACLE[f"archive_stored_se_{_name}"] = ORACLE[f"archive_roundtrip_{_name}"]
put("archive_stored_pe_lossless", READS, "select read_id, head, seq, qua, mate_seq, mate_qua from pairs")
put("archive_stored_pe_thorough", READS, "select read_id, head, seq, qua, mate_seq, mate_qua from pairs")
put("archive_stored_pe_reduced", READS, f"select read_id, split_part(head, ' ', 1) as head, seq, {EIGHT} as qua, mate_seq, {MATE_EIGHT} as mate_qua from pairs")
put("archive_stored_pe_max", READS, f"select read_id, '@' as head, seq, {BINARY} as qua, mate_seq, {MATE_BINARY} as mate_qua from pairs")
