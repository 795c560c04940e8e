"""Registered queries: each applies one operator to the derived reads of a data folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna, numbers, phred
from ..operators import bins, codecs, contigs, forest, headers, lineage, matching, minimizers, order, pairs, qualities, quantize, rebin
from ..sources import fastq
from ..streaming import follow
from . import archive
from .fixture import derived_reads

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _binned(spark: SparkSession, sf_dir: str, skip: int = 0) -> DataFrame:
    return minimizers.minimizer_se(derived_reads(spark, sf_dir), skip=skip)


def _kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct k-mers of all places of all reads."""
    starts = F.sequence(F.lit(1), F.length("seq") - 7)
    return derived_reads(spark, sf_dir).select(F.explode(F.transform(starts, lambda i: F.substr("seq", i, F.lit(8)))).alias("kmer")).distinct()


def _firsts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of equal reads, kept: nodes are these alone, and signatures are found once."""
    return lineage.durable(matching.duplicates(_binned(spark, sf_dir)).drop("n_copies"))


def _nodes(spark: SparkSession, sf_dir: str, window: int = 8) -> DataFrame:
    return matching.lz_nodes(_binned(spark, sf_dir), window=window)


@query
def bin_stats(spark, sf_dir):
    return bins.bin_stats(_binned(spark, sf_dir))


@query
def reads_scan(spark, sf_dir):
    return derived_reads(spark, sf_dir)


@query
def reads_project(spark, sf_dir):
    return derived_reads(spark, sf_dir).select("read_id", "seq")


@query
def header_trim(spark, sf_dir):
    return derived_reads(spark, sf_dir).select("read_id", headers.trimmed(F.col("head")).alias("head"))


@query
def revcomp_se(spark, sf_dir):
    return derived_reads(spark, sf_dir).select("read_id", dna.revcomp(F.col("seq")).alias("seq"), F.reverse("qua").alias("qua"))


@query
def revcomp_pe(spark, sf_dir):
    flipped = minimizers.flip_pair(derived_reads(spark, sf_dir, True), F.lit(True))
    return flipped.select("read_id", "seq", "qua", "mate_seq", "mate_qua")


@query
def mate_swap(spark, sf_dir):
    swapped = minimizers.swap_mates(derived_reads(spark, sf_dir, True), F.lit(True))
    return swapped.select("read_id", "seq", "qua", "mate_seq", "mate_qua")


@query
def kmer_codes(spark, sf_dir):
    return _kmers(spark, sf_dir).select("kmer", dna.kmer_code(F.col("kmer")).alias("code"))


@query
def signature_text(spark, sf_dir):
    code = dna.kmer_code(F.col("kmer"))
    return _kmers(spark, sf_dir).select(code.alias("code")).distinct().select("code", dna.code_text(F.col("code")).alias("text"))


@query
def signature_revcomp(spark, sf_dir):
    rows = _kmers(spark, sf_dir).select("kmer", dna.kmer_code(F.col("kmer")).alias("code"))
    return rows.select("code", dna.code_revcomp(F.col("code")).alias("rc_code")).distinct()


@query
def signature_validity(spark, sf_dir):
    return _kmers(spark, sf_dir).select("kmer", dna.is_valid_signature(F.col("kmer")).alias("valid"))


@query
def n_filter(spark, sf_dir):
    return derived_reads(spark, sf_dir).where(dna.is_n_heavy(F.col("seq"))).select("read_id", dna.n_count(F.col("seq")).alias("n"))


@query
def plain_dna(spark, sf_dir):
    return derived_reads(spark, sf_dir).where(dna.is_plain(F.col("seq"))).select("read_id")


@query
def lowq_signature_filter(spark, sf_dir):
    rows = _binned(spark, sf_dir).where("signature <> 65536")
    return rows.where(dna.min_quality_at(F.col("qua"), F.col("minim_pos")) >= 33 + 6).select("read_id")


def _assigned(df: DataFrame) -> DataFrame:
    return df.select("read_id", "signature", "sig_text", "minim_pos", "is_rev")


@query
def minimizer_se(spark, sf_dir):
    return _assigned(_binned(spark, sf_dir))


@query
def minimizer_skip10(spark, sf_dir):
    return _assigned(_binned(spark, sf_dir, 10))


@query
def minimizer_pe(spark, sf_dir):
    df = minimizers.minimizer_pe(derived_reads(spark, sf_dir, True))
    return df.select("read_id", "signature", "minim_pos", "is_rev", "is_swapped", "seq", "mate_seq")


@query
def orientation_restore(spark, sf_dir):
    return minimizers.restored(_binned(spark, sf_dir)).select("read_id", "seq", "qua")


@query
def orientation_restore_pe(spark, sf_dir):
    df = minimizers.minimizer_pe(derived_reads(spark, sf_dir, True))
    return minimizers.restored(df, True).select("read_id", "seq", "qua", "mate_seq", "mate_qua")


@query
def bin_len_minmax(spark, sf_dir):
    return bins.bin_lengths(_binned(spark, sf_dir))


@query
def bin_filter_min(spark, sf_dir):
    return bins.large_bins(_binned(spark, sf_dir), 64).select("read_id", "signature", "bin_size")


@query
def small_bins_to_n(spark, sf_dir):
    return bins.small_to_n(_binned(spark, sf_dir), 8).select("read_id", "signature", "minim_pos", "is_rev", "seq")


@query
def small_and_n_union(spark, sf_dir):
    return bins.small_and_n(_binned(spark, sf_dir), 64).select("read_id", "seq")


@query
def base_freq(spark, sf_dir):
    return qualities.base_freq(derived_reads(spark, sf_dir))


@query
def qual_freq(spark, sf_dir):
    return qualities.qual_freq(derived_reads(spark, sf_dir))


@query
def qual_cond_counts(spark, sf_dir):
    return qualities.cond_counts(derived_reads(spark, sf_dir))


@query
def qual_marginal(spark, sf_dir):
    return qualities.marginals(qualities.cond_counts(derived_reads(spark, sf_dir)))


@query
def qual_entropy(spark, sf_dir):
    rows = qualities.entropies(qualities.cond_counts(derived_reads(spark, sf_dir)))
    return rows.select("col", F.round("bits", 6).alias("bits"))


@query
def qual_divergence(spark, sf_dir):
    rows = qualities.divergences(qualities.cond_counts(derived_reads(spark, sf_dir)))
    return rows.select("col", F.round("kl", 6).alias("kl"))


@query
def qual_adaptive_bits(spark, sf_dir):
    rows = qualities.adaptive_bits(qualities.cond_counts(derived_reads(spark, sf_dir)), ["prev"], "cur", 64)
    return rows.select("prev", "n", F.round("bits", 2).alias("bits"))


@query
def qual_position_bits(spark, sf_dir):
    counts = qualities.positioned(qualities.cond_counts(derived_reads(spark, sf_dir)), 100)
    return qualities.adaptive_bits(counts, ["part", "prev"], "cur", 64).select("part", "prev", "n", F.round("bits", 2).alias("bits"))


@query
def whole_logs(spark, sf_dir):
    x = F.col("read_id")
    return derived_reads(spark, sf_dir).where("read_id > 0").select("read_id", numbers.int_log(10, x).alias("log10"), numbers.bit_length(x).alias("bits"))


@query
def records_head(spark, sf_dir):
    return order.first_records(derived_reads(spark, sf_dir), 100)


@query
def records_shuffled(spark, sf_dir):
    return order.shuffled(derived_reads(spark, sf_dir))


@query
def position_steps(spark, sf_dir):
    return order.position_steps(_binned(spark, sf_dir))


@query
def bins_allowed(spark, sf_dir):
    return order.in_sized_bins(_binned(spark, sf_dir), 8).select("read_id", "signature")


def _mapped(spark, sf_dir, column) -> DataFrame:
    return derived_reads(spark, sf_dir).select("read_id", column.alias("qua"))


@query
def qual_binary(spark, sf_dir):
    return _mapped(spark, sf_dir, phred.binary(F.col("qua")))


@query
def qual_illumina8(spark, sf_dir):
    return _mapped(spark, sf_dir, phred.illumina_8(F.col("qua")))


@query
def qual_nmask(spark, sf_dir):
    return _mapped(spark, sf_dir, phred.n_masked(F.col("seq"), phred.binary(F.col("qua")), 6))


@query
def qual_phred64_to_33(spark, sf_dir):
    rows = derived_reads(spark, sf_dir).withColumn("qua", phred.rebased(F.col("qua"), 33, 64))
    return rows.select("read_id", F.col("qua").alias("qua64"), phred.rebased(F.col("qua"), 64, 33).alias("qua"))


@query
def qual_mean_distortion(spark, sf_dir):
    rows = qualities.mean_distortion(derived_reads(spark, sf_dir), phred.illumina_8(F.col("qua")))
    return rows.select(*(F.round(c, 6).alias(c) for c in ("l1", "mse", "lorentz")))


@query
def header_tokens(spark, sf_dir):
    return headers.tokens(derived_reads(spark, sf_dir))


@query
def header_profile(spark, sf_dir):
    return headers.profile(derived_reads(spark, sf_dir))


@query
def header_pe_field(spark, sf_dir):
    first = derived_reads(spark, sf_dir, True)
    return headers.pair_field(first.select("read_id", "head").unionByName(first.select("read_id", F.col("mate_head").alias("head"))))


@query
def header_encode(spark, sf_dir):
    return headers.encoded(derived_reads(spark, sf_dir))[0]


@query
def header_roundtrip(spark, sf_dir):
    return headers.roundtrip(derived_reads(spark, sf_dir))


@query
def header_auto(spark, sf_dir):
    return bins.auto_headers(_binned(spark, sf_dir)).select("read_id", "head")


@query
def header_mate(spark, sf_dir):
    return derived_reads(spark, sf_dir).select("read_id", headers.mate_header(F.col("head"), 4).alias("head"))


@query
def fastq_lines(spark, sf_dir):
    from ..sources.fastq import lines

    return lines(derived_reads(spark, sf_dir))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{lineage.shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _dropped(reads: DataFrame, path: str) -> DataFrame:
    """The rows, kept; the files they were read from go."""
    kept = lineage.durable(reads)
    lineage.remove(reads.sparkSession, path)
    return kept


@query
def fastq_files(spark, sf_dir):
    """Written by the sink and read back in splits."""
    path = _folder(spark, "fastq")
    fastq.write_fastq(derived_reads(spark, sf_dir), path)
    return _dropped(fastq.read_fastq(spark, [path], split_bytes=1 << 20).where("bad is null").select("head", "seq", "qua"), path)


@query
def fastq_pair_files(spark, sf_dir):
    """Both mates written in step, cut at equal records and read back in pairs."""
    path = _folder(spark, "fastq-pairs")
    fastq.write_fastq(derived_reads(spark, sf_dir, True), f"{path}/1", f"{path}/2")
    return _dropped(fastq.read_fastq(spark, [f"{path}/1"], [f"{path}/2"], split_bytes=1 << 20).where("bad is null").drop("read_id", "bad"), path)


@query
def fastq_damaged(spark, sf_dir):
    """Text in which some records lost their third line: whole records, and what is left of the others."""
    path = _folder(spark, "fastq-damaged")
    reads = derived_reads(spark, sf_dir)
    plus = F.when(F.col("read_id") % 97 != 0, F.lit("+"))
    reads.select(F.concat_ws("\n", "head", "seq", plus, "qua").alias("value")).write.text(path)
    rows = fastq.read_fastq(spark, [path], split_bytes=1 << 18)
    whole = F.array(F.struct("head", "seq", "qua"))
    # a quality line that begins with @ is a piece of its own
    none = F.lit(None).cast("string")
    lost = F.transform(F.split("bad", "\n"), lambda x: F.struct(x.alias("head"), none.alias("seq"), none.alias("qua")))
    return _dropped(rows.select(F.inline(F.when(F.col("bad").isNull(), whole).otherwise(lost))), path)


@query
def fastq_qualities(spark, sf_dir):
    """The dry-run sink's files."""
    path = _folder(spark, "fastq-dry")
    fastq.write_qualities(derived_reads(spark, sf_dir), path)
    return _dropped(spark.read.text(path), path)


@query
def fastq_stream(spark, sf_dir):
    """Files followed as a stream, to the end."""
    path = _folder(spark, "fastq-stream")
    fastq.write_fastq(derived_reads(spark, sf_dir), f"{path}/in")
    rows = follow.follow_fastq(spark, f"{path}/in").where("bad is null").select("head", "seq", "qua")
    rows.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return _dropped(spark.read.schema(rows.schema).parquet(f"{path}/out"), path)


@query
def read_sort_rank(spark, sf_dir):
    return matching.ranked(_binned(spark, sf_dir)).select("read_id", "signature", "rank")


@query
def duplicates(spark, sf_dir):
    return matching.duplicates(_binned(spark, sf_dir))


@query
def dedup_reads(spark, sf_dir):
    return matching.duplicates(_binned(spark, sf_dir)).select("read_id")


@query
def lz_match_w8(spark, sf_dir):
    return _nodes(spark, sf_dir).select("read_id", "signature", "rank", "node_type", "parent_id", "shift", "cost", "no_mismatch")


@query
def lz_match_w255(spark, sf_dir):
    return _nodes(spark, sf_dir, 255).select("read_id", "signature", "rank", "node_type", "parent_id", "shift", "cost", "no_mismatch")


@query
def lz_prefix_search(spark, sf_dir):
    firsts = _firsts(spark, sf_dir)
    rows = matching.by_prefix(matching.lz_nodes(firsts, 3), firsts, 8)
    return rows.select("read_id", "signature", "rank", "node_type", "parent_id", "shift", "cost", "no_mismatch")


@query
def mate_number_join(spark, sf_dir):
    rows = derived_reads(spark, sf_dir, True)
    second = rows.where("read_id % 11 <> 3").select("read_id", F.col("mate_head").alias("head"), F.col("mate_seq").alias("seq"), F.col("mate_qua").alias("qua"))
    return pairs.by_number(rows.where("read_id % 13 <> 5").select("read_id", "head", "seq", "qua"), second)


@query
def lz_cost_hist(spark, sf_dir):
    return matching.histogram(_nodes(spark, sf_dir), "cost")


@query
def lz_shift_hist(spark, sf_dir):
    return matching.histogram(_nodes(spark, sf_dir), "shift")


@query
def lz_mismatch_hist(spark, sf_dir):
    rows = matching.expensive(_nodes(spark, sf_dir))
    return rows.groupBy(F.col("mismatches").alias("key")).agg(F.count("*").alias("cnt"))


@query
def lz_parent_distance(spark, sf_dir):
    return matching.parent_distance(_nodes(spark, sf_dir))


@query
def lz_expensive(spark, sf_dir):
    return matching.expensive(_nodes(spark, sf_dir))


@query
def forest_depth(spark, sf_dir):
    return forest.depths(_nodes(spark, sf_dir))


@query
def tree_size(spark, sf_dir):
    return forest.tree_sizes(_nodes(spark, sf_dir))


def _eligible(p: int) -> Query:
    def run(spark, sf_dir):
        return _binned(spark, sf_dir).where(rebin.is_eligible(F.col("signature"), p)).select("read_id", "signature")

    return run


for _p in (2, 4, 8):
    QUERIES[f"rebin_eligible_p{_p}"] = _eligible(_p)


@query
def rebin_target_single(spark, sf_dir):
    return rebin.single_targets(_binned(spark, sf_dir), 2).select("read_id", "signature", "new_signature", "new_pos", "flips")


@query
def rebin_target_allowed(spark, sf_dir):
    binned = _binned(spark, sf_dir)
    rows = rebin.single_targets(binned, 2, allowed=rebin.allowed_targets(binned, 40))
    return rows.select("read_id", "signature", "new_signature", "new_pos", "flips")


@query
def rebin_diff(spark, sf_dir):
    rows = rebin.single_targets(_binned(spark, sf_dir), 2)
    after = rows.select(F.coalesce("new_signature", "signature").alias("signature"))
    return bins.bin_difference(rows.select("signature"), after)


@query
def rebin_round(spark, sf_dir):
    return rebin.rebin_round(_binned(spark, sf_dir), 2, window=8)


@query
def contig_vote(spark, sf_dir):
    return contigs.votes(_binned(spark, sf_dir))


@query
def contig_variants(spark, sf_dir):
    return contigs.variants(_binned(spark, sf_dir))


def _grown(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Contigs, and the reads they are made of."""
    firsts = _firsts(spark, sf_dir)
    nodes = lineage.durable(matching.lz_nodes(firsts, 64))
    return contigs.contigs(nodes, forest.depths(nodes), firsts), firsts


@query
def contig_growth(spark, sf_dir):
    return _grown(spark, sf_dir)[0]


@query
def contig_histograms(spark, sf_dir):
    return contigs.histograms(contig_growth(spark, sf_dir))


@query
def contig_position_steps(spark, sf_dir):
    made, firsts = _grown(spark, sf_dir)
    return contigs.position_steps(lineage.durable(made), firsts)


@query
def contig_members_sound(spark, sf_dir):
    """Contigs whose members' uncovered ends, variant letters and consensus do not give a member back: none."""
    made, firsts = _grown(spark, sf_dir)
    cells = contigs.member_cells(lineage.durable(made), firsts)
    return cells.where("base <> consensus and not is_variant").groupBy("contig_id").agg(F.count("*").alias("n_wrong"))


@query
def stream_sizes(spark, sf_dir):
    return archive.stream_sizes(archive.pack(derived_reads(spark, sf_dir), archive.PROFILES["lossless"]))


@query
def mate_zip_join(spark, sf_dir):
    rows = derived_reads(spark, sf_dir, True)
    second = rows.select("read_id", F.col("mate_seq").alias("seq"), F.col("mate_qua").alias("qua"))
    return pairs.zip_mates(derived_reads(spark, sf_dir), second)


@query
def qual_replace_join(spark, sf_dir):
    rows = derived_reads(spark, sf_dir)
    return pairs.replace_qualities(rows, rows.select("read_id", phred.illumina_8(F.col("qua")).alias("qua"))).select("read_id", "head", "seq", "qua")


@query
def pair_duplicates(spark, sf_dir):
    return matching.pair_duplicates(minimizers.minimizer_pe(derived_reads(spark, sf_dir, True)), window=8)


@query
def lz_match_pairs(spark, sf_dir):
    return matching.lz_nodes(minimizers.minimizer_pe(derived_reads(spark, sf_dir, True)), window=8, paired=True)


@query
def pair_match(spark, sf_dir):
    return pairs.pair_matches(minimizers.minimizer_pe(derived_reads(spark, sf_dir, True)))


@query
def signature_diff(spark, sf_dir):
    return pairs.signature_difference(derived_reads(spark, sf_dir, True))


@query
def alphabet_union(spark, sf_dir):
    return pairs.alphabet_union(derived_reads(spark, sf_dir, True))


@query
def top_signatures(spark, sf_dir):
    return bins.top_signatures(_binned(spark, sf_dir), 4)


@query
def match_rle(spark, sf_dir):
    binned = _binned(spark, sf_dir)
    return codecs.match_runs(codecs.match_flags(matching.lz_nodes(binned, 8), binned))


@query
def rle0(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    rows = matching.parent_distance(nodes).join(nodes.select("read_id", "signature", "rank"), "read_id")
    return codecs.rle0_streams(rows).select("signature", "n_symbols", F.hex("stream").alias("stream"))


@query
def qvz_codebook(spark, sf_dir):
    rows = derived_reads(spark, sf_dir)
    return quantize.codebook_rows(rows, quantize.train(rows))


@query
def qvz_apply(spark, sf_dir):
    rows = derived_reads(spark, sf_dir)
    return quantize.apply_codebook(rows, quantize.train(rows))


def _roundtrip(p: archive.Profile, paired: bool = False, stored: bool = False) -> Query:
    def run(spark, sf_dir):
        reads = derived_reads(spark, sf_dir, paired)
        scratch = _folder(spark, "rows") if stored else None
        tables = archive.pack(reads.drop("mate_head"), p, scratch=scratch)
        if stored:
            path = _folder(spark, "archive")
            archive.store(tables, path, p)
            tables = archive.load(spark, path)
            lineage.remove(spark, scratch)
        return archive.unpack(tables)

    return run


for _name, _p in archive.PROFILES.items():
    QUERIES[f"archive_roundtrip_{_name}"] = _roundtrip(_p)
    QUERIES[f"archive_stored_se_{_name}"] = _roundtrip(archive.thorough(_p, 64), stored=True)
    QUERIES[f"archive_stored_pe_{_name}"] = _roundtrip(_p, paired=True, stored=True)
QUERIES["archive_roundtrip_fast"] = _roundtrip(archive.fast(archive.PROFILES["lossless"]))
QUERIES["archive_stored_pe_thorough"] = _roundtrip(archive.thorough(archive.PROFILES["lossless"], 64), paired=True, stored=True)
