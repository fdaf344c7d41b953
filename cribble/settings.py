"""Parameters and their defaults.

Everything a run may want to change is a field of a frozen dataclass or a
function argument; the values below are only the defaults.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values: these must be exactly so for results to agree -----------

DISCOVERED = "DISCOVERED"
DOWNLOADED = "DOWNLOADED"
SKIPPED_LENGTH = "SKIPPED_LENGTH"
UNSUPPORTED_PLATFORM = "UNSUPPORTED_PLATFORM"
ERROR_DOWNLOAD = "ERROR_DOWNLOAD"
SCREENED = "SCREENED"
ERROR_SCREEN = "ERROR_SCREEN"
WEAK_POSITIVE = "WEAK_POSITIVE"
WEAK_NEGATIVE = "WEAK_NEGATIVE"
SCREENED_NO_LABEL = "SCREENED_NO_LABEL"
POTENTIAL = "POTENTIAL_LB"
BORDERLINE = "BORDERLINE_LB"
REJECTED = "REJECTED"
ERROR_SCORING = "ERROR_SCORING"

# The domain of the queue summary, in report order.
SUMMARY_STATUSES = (
    "DISCOVERED", "DOWNLOADED", "SCREENED", "WEAK_POSITIVE", "WEAK_NEGATIVE",
    "POTENTIAL_LB", "BORDERLINE_LB", "REJECTED", "ERROR_DOWNLOAD",
    "ERROR_SCREEN", "ERROR_SCORING",
)
RESCORE_STATUSES = (
    "REJECTED", "BORDERLINE_LB", "POTENTIAL_LB", "WEAK_POSITIVE", "WEAK_NEGATIVE",
)
LABEL_RESET_STATUSES = ("WEAK_POSITIVE", "WEAK_NEGATIVE", "SCREENED_NO_LABEL")

PODCAST_PLATFORMS = ("podcast", "podcast_rss")
DOWNLOAD_PLATFORMS = ("youtube", "podcast", "podcast_rss", "tiktok")

AUDIO_URL_EXTENSIONS = (".mp3", ".m4a", ".wav", ".ogg")
AUDIO_NAME_EXTENSIONS = (".mp3", ".m4a", ".wav", ".aac", ".ogg")

BLOCKED_HOST = "buzzsprout.com"
BLOCKED_HOST_MESSAGE = "host-blocked (buzzsprout)"
SHORTS_MESSAGE = "youtube_short_skipped"
MISSING_TRANSCRIPT_MESSAGE = "Missing transcript"
MISSING_FEATURES_MESSAGE = "Missing features"
NO_DURATION_MESSAGE = "No duration"
NO_TRANSCRIPT_EXCERPT = "(no transcript available)"
EMPTY_TRANSCRIPT_EXCERPT = "(empty transcript)"

TIKTOK_STOPWORDS = (
    "video", "videos", "fyp", "foryou", "foryoupage",
    "trending", "viral", "explore", "love", "fun",
)
FACEBOOK_STOPWORDS = (
    "video", "videos", "news", "official", "page", "live", "tv", "channel",
)
INSTAGRAM_STOPWORDS = ("reels", "explore", "viral", "love", "instagood")

#: How a platform's tags are cleaned: least length, words that say nothing, whether inner blanks stay.
TAG_RULES = {
    "tiktok": (4, TIKTOK_STOPWORDS, False),
    "instagram": (4, INSTAGRAM_STOPWORDS, True),
    "facebook": (3, FACEBOOK_STOPWORDS, False),
}

RELEVANT_LANGUAGE_PARTS = ("ar",)
RELEVANT_TITLE_PARTS = ("leban", "لبنان")

# High-precision markers counted as ``strong_lb_hits``. Two carry a trailing blank.
STRONG_MARKERS = (
    "شو", "ليش", "هيك", "هلّق", "هلق", "عنجد", "عن جد",
    "بدّي", "بدي", "ما في", "مابي", "مش", "عم ", "رح ",
    "كتير", "كتير ", "إنت", "انت", "إنتي", "انتي", "كنتي",
    "وين", "هون", "هونيك", "هيدا", "هيدي", "هدول",
)

# Contrastive corpus: class code -> role.
CONTRASTIVE_ROLES = {
    "EGY": "egyptian",
    "MSA": "msa",
    "KSA": "gulf",
    "KWT": "gulf",
    "UAE": "gulf",
    "QAT": "gulf",
    "OMA": "gulf",
    "LEB": "lebanese",
}
CONTRASTIVE_QUOTA = 1000

# Annotation sample: status -> rows wanted.
SAMPLE_STRATA = {
    "WEAK_POSITIVE": 45,
    "POTENTIAL_LB": 90,
    "BORDERLINE_LB": 60,
    "REJECTED": 60,
    "WEAK_NEGATIVE": 45,
}
TRUTH_LABELS = ("lebanese", "mostly_lebanese", "not_lebanese", "unclear", "skip")
POSITIVE_TRUTH = ("lebanese", "mostly_lebanese")
UNCLEAR_TRUTH = "unclear"
SKIP_TRUTH = "skip"

SEED = 42


# --- Parameter groups ------------------------------------------------------

@dataclass(frozen=True)
class AudioLimits:
    min_seconds: int = 6
    max_seconds: int = 1200
    chunk_seconds: int = 20
    chunk_count: int = 3
    clip_seconds: int = 60


@dataclass(frozen=True)
class LexiconWeights:
    """Weights of the lexical score; penalties are positive and subtracted."""

    lb: float = 1.8
    msa: float = 0.6
    egy: float = 1.0
    gulf: float = 1.0
    sy: float = 0.5
    dominance_ratio: float = 0.60
    dominance_penalty: float = 0.7
    scale: float = 5.0


@dataclass(frozen=True)
class Thresholds:
    potential: float = 0.75
    borderline: float = 0.50
    min_strong_hits: int = 1
    language: str = "ar"
    min_language_probability: float = 0.70
    min_training_rows: int = 50
    holdout_fraction: float = 0.2


@dataclass(frozen=True)
class Caps:
    """Per-source limits applied while discovering."""

    entries_per_page: int = 50
    results_per_query: int = 20
    channels_per_query: int = 10
    episodes_per_feed: int = 500
    max_feeds: int = 10_000


@dataclass(frozen=True)
class SourceLists:
    """Configured source lists.

    The ``trusted_*`` lists win; each empty *positive* list falls back to the
    platform list of its kind. Negative lists never fall back.
    """

    channels: tuple[str, ...] = ()
    feeds: tuple[str, ...] = ()
    users: tuple[str, ...] = ()
    trusted_positive_channels: tuple[str, ...] = ()
    trusted_positive_feeds: tuple[str, ...] = ()
    trusted_positive_users: tuple[str, ...] = ()
    trusted_negative_channels: tuple[str, ...] = ()
    trusted_negative_feeds: tuple[str, ...] = ()
    trusted_negative_users: tuple[str, ...] = ()


@dataclass(frozen=True)
class Settings:
    audio: AudioLimits = field(default_factory=AudioLimits)
    weights: LexiconWeights = field(default_factory=LexiconWeights)
    thresholds: Thresholds = field(default_factory=Thresholds)
    caps: Caps = field(default_factory=Caps)
    sources: SourceLists = field(default_factory=SourceLists)
