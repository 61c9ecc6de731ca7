"""From clean bitext to sharded, binarized training data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tandem.operators import cleaning as c
from tandem.operators import corpus as d
from tandem.operators import subword as s
from tandem.operators import unigram as u
from tandem.session import staged

Subwords = list[tuple[str, str]] | u.UnigramModel


@dataclass(frozen=True)
class DatasetConfig:
    mode: str = "bpe"
    min_pieces: int = 1
    max_pieces: int = 250
    ratio: float = 3
    n_shards: int = d.N_SHARDS
    min_lines: int = d.MIN_CHUNK_LINES
    seed: int = 1


def learn_subwords(bitext: DataFrame, vocab_size: int = s.VOCAB_SIZE, sample: int | None = None, seed: int = 1, mode: str = "bpe") -> Subwords:
    """Merges or a unigram model from each language's text with the hub; from that many random sentences if ``sample`` is given."""
    mono = d.mono_corpus(bitext)
    if sample is not None:
        mono = d.sample_exact(mono, sample, seed, ("lang", "pair", "line_no"))
    counts = s.word_counts(mono)
    return u.train_unigram(counts, vocab_size) if mode == "unigram" else s.train_subwords(counts, vocab_size)


def encode_and_trim(bitext: DataFrame, merges: Subwords | None, cfg: DatasetConfig = DatasetConfig()) -> DataFrame:
    """Pieces of both sides, then the length and ratio filters: no shuffle."""
    df = s.encode_pieces(bitext, {"src": "src_pieces", "tgt": "tgt_pieces"}, cfg.mode, merges)
    return c.filter_ratio(c.filter_length(df, cfg.min_pieces, cfg.max_pieces), cfg.ratio)


def training_shards(bitext: DataFrame, merges: Subwords | None, dictionary: DataFrame | None = None,
                    vocab_size: int = s.VOCAB_SIZE, cfg: DatasetConfig = DatasetConfig()) -> DataFrame:
    """``shard, pair, line_no, src_ids, tgt_ids``: every shard holds every pair, in random chunks."""
    return shards_of(trimmed_pieces(bitext, merges, cfg), dictionary, vocab_size, cfg)


def trimmed_pieces(bitext: DataFrame, merges: Subwords | None, cfg: DatasetConfig = DatasetConfig()) -> DataFrame:
    """Pieces within the limits, written once: vocabulary, counts and numbering read them again."""
    return staged(encode_and_trim(bitext, merges, cfg).drop("src", "tgt"), "pieces")


def shards_of(pieces: DataFrame, dictionary: DataFrame | None = None, vocab_size: int = s.VOCAB_SIZE,
              cfg: DatasetConfig = DatasetConfig()) -> DataFrame:
    """Training shards of encoded rows. Ids are looked up before rows are repeated into shards."""
    if dictionary is None:
        dictionary = s.build_dictionary(s.vocabulary(pieces, vocab_size))
    chunked = d.assign_chunk(pieces, cfg.n_shards, cfg.min_lines, cfg.seed)
    ids = s.binarize(chunked, dictionary, {"src_pieces": "src_ids", "tgt_pieces": "tgt_ids"})
    return d.fill_shards(ids, cfg.n_shards).select("shard", "pair", "line_no", "src_ids", "tgt_ids")


def validation_shards(texts: DataFrame, directions: DataFrame, merges: Subwords | None, dictionary: DataFrame,
                      cfg: DatasetConfig = DatasetConfig()) -> DataFrame:
    """The validation set of every direction, whole, in every shard; each text is encoded once."""
    encoded = s.encode_pieces(texts, {"text": "pieces"}, cfg.mode, merges)
    ids = s.binarize(encoded, dictionary, {"pieces": "text"}).select("sent_id", "lang", "text")
    paired = d.parallel_directions(ids, directions).withColumnsRenamed({"src": "src_ids", "tgt": "tgt_ids"})
    return d.replicate_valid(paired, cfg.n_shards).select("shard", "pair", "line_no", "src_ids", "tgt_ids")
