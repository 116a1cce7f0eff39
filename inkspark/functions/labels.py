"""Class labels of letter forms: their characters, expected dots and positions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession

TATWEEL = "ـ"

# Position tag and label suffix.
POSITIONS = {"isolated": "Isolated", "initial": "Start", "medial": "Middle", "final": "End"}

# Letter names with all four forms, their character, dots above and below.
LETTERS = [
    ("Alef", "ا", 0, 0),
    ("Baa", "ب", 0, 1),
    ("Taa", "ت", 2, 0),
    ("Thaa", "ث", 3, 0),
    ("Jeem", "ج", 0, 1),
    ("Haa", "ح", 0, 0),
    ("Khaa", "خ", 1, 0),
    ("Dal", "د", 0, 0),
    ("Thal", "ذ", 1, 0),
    ("Raa", "ر", 0, 0),
    ("Zain", "ز", 1, 0),
    ("Seen", "س", 0, 0),
    ("Sheen", "ش", 3, 0),
    ("Saad", "ص", 0, 0),
    ("Daad", "ض", 1, 0),
    ("Ttaa", "ط", 0, 0),
    ("Dhaa", "ظ", 1, 0),
    ("Ain", "ع", 0, 0),
    ("Ghain", "غ", 1, 0),
    ("Faa", "ف", 1, 0),
    ("Qaaf", "ق", 2, 0),
    ("Kaf", "ك", 0, 0),
    ("Lam", "ل", 0, 0),
    ("Meem", "م", 0, 0),
    ("Noon", "ن", 1, 0),
    ("Heh", "ه", 0, 0),
    ("Waw", "و", 0, 0),
    ("Yaa", "ي", 0, 2),
]

# Names with some forms only, their character without joining strokes.
PARTIAL = {
    "Hamza": ("ء", ["Isolated"]),
    "Hamza_Above": ("ء", ["Isolated"]),
    "Alef_Hamza": ("أ", ["Isolated"]),
    "Alef_Hamza_Above": ("أ", ["Isolated", "Start", "End"]),
    "Alef_Hamza_Below": ("إ", ["Isolated", "End"]),
    "Alef_Madda": ("آ", ["Isolated", "End"]),
    "Waw_Hamza": ("ؤ", ["Isolated", "End"]),
    "Yeh_Hamza": ("ئ", ["Isolated", "Start", "Middle", "End"]),
    "Teh_Marbuta": ("ة", ["Isolated", "End"]),
    "Ta_Marbuta": ("ة", ["Isolated", "End"]),
    "Alef_Wasla": ("ٱ", ["Isolated", "Start"]),
    "Laa": ("لا", ["Isolated", "End"]),
    "Lam_Alf_Mad": ("لآ", ["Isolated", "End"]),
    "Lam_Alf_Hamza": ("لأ", ["Isolated", "End"]),
}
# Names whose final form is written without a joining stroke.
UNJOINED = ("Teh_Marbuta", "Ta_Marbuta", "Laa", "Lam_Alf_Mad", "Lam_Alf_Hamza")
# Dots above and below of further names.
OTHER_DOTS = {"Hamza": (0, 0), "Alef_Hamza_Above": (0, 0), "Alef_Hamza_Below": (0, 0), "Alef_Madda": (0, 0), "Waw_Hamza": (0, 0), "Alef_Wasla": (0, 0), "Laa": (0, 0), "Teh_Marbuta": (2, 0), "Yeh_Hamza": (0, 2)}
# Digit names.
DIGITS = ["Zero", "One", "Two", "Three", "Four", "Five", "Six", "Seven", "Eight", "Nine"]

# Other spellings of letter names.
ALIASES = {
    "Ba": "Baa",
    "Ta": "Taa",
    "Tha": "Thaa",
    "Gem": "Jeem",
    "Gen": "Ghain",
    "Ha": "Heh",
    "Kha": "Khaa",
    "Jim": "Jeem",
    "Dhal": "Thal",
    "Ra": "Raa",
    "Sin": "Seen",
    "Shin": "Sheen",
    "Sad": "Saad",
    "Dad": "Daad",
    "Tah": "Ttaa",
    "Zah": "Dhaa",
    "Fa": "Faa",
    "Qaf": "Qaaf",
    "Mim": "Meem",
    "Mem": "Meem",
    "Nun": "Noon",
    "Ya": "Yaa",
    "Ye": "Yaa",
    "Alf": "Alef",
    "Zal": "Thal",
    "Geem": "Jeem",
    "Dha": "Dhaa",
    "Yeh": "Yaa",
    "Non": "Noon",
    "Wow": "Waw",
    "Kef": "Kaf",
    "Laam": "Lam",
    "Shen": "Sheen",
    "Zin": "Zain",
    "Yaa_Dot": "Yaa",
    "Lam_Alf": "Laa",
    "Alf_Hamza_Under": "Alef_Hamza_Below",
    "Alf_Hamza_Above": "Alef_Hamza_Above",
}
# The aliases that have no expected dots of their own.
DOTLESS_ALIASES = ("Lam_Alf", "Alf_Hamza_Under", "Alf_Hamza_Above")

# Letter of a dotless body by its dots above and below.
BODIES = [
    ("ba", 0, 1, "ب"),
    ("ba", 2, 0, "ت"),
    ("ba", 3, 0, "ث"),
    ("nun", 1, 0, "ن"),
    ("ya", 0, 2, "ي"),
    ("haa", 0, 0, "ح"),
    ("haa", 0, 1, "ج"),
    ("haa", 1, 0, "خ"),
    ("dal", 0, 0, "د"),
    ("dal", 1, 0, "ذ"),
    ("ra", 0, 0, "ر"),
    ("ra", 1, 0, "ز"),
    ("sin", 0, 0, "س"),
    ("sin", 3, 0, "ش"),
    ("sad", 0, 0, "ص"),
    ("sad", 1, 0, "ض"),
    ("ta", 0, 0, "ط"),
    ("ta", 1, 0, "ظ"),
    ("ayn", 0, 0, "ع"),
    ("ayn", 1, 0, "غ"),
    ("fa", 1, 0, "ف"),
    ("qa", 2, 0, "ق"),
    ("alef", 0, 0, "ا"),
    ("lam", 0, 0, "ل"),
    ("mim", 0, 0, "م"),
    ("ha", 0, 0, "ه"),
    ("waw", 0, 0, "و"),
    ("kaf", 0, 0, "ك"),
]
# Training labels of equal glyphs.
TRAINING_SYNONYMS = {
    "Ta_Marbuta_Isolated": "Teh_Marbuta_Isolated",
    "Ta_Marbuta_End": "Teh_Marbuta_End",
    "Alef_Hamza_Isolated": "Alef_Hamza_Above_Isolated",
}


def _form(char: str, suffix: str, joined: bool = True) -> str:
    """A character with the strokes that join it to its neighbours."""
    left = TATWEEL if joined and suffix in ("Middle", "End") else ""
    return left + char + (TATWEEL if suffix in ("Start", "Middle") else "")


def label_table() -> dict[str, str]:
    """Label to character with joining strokes, aliases included where the canonical label exists and the alias doesn't."""
    out = {f"{name}_{suffix}": _form(char, suffix) for name, char, *_ in LETTERS for suffix in POSITIONS.values()}
    out |= {f"{name}_{suffix}": _form(char, suffix, name not in UNJOINED) for name, (char, forms) in PARTIAL.items() for suffix in forms}
    out |= {name: chr(0x660 + k) for k, digit in enumerate(DIGITS) for name in (digit, str(k))}
    extra = {f"{alias}_{suffix}": out[f"{name}_{suffix}"] for (alias, name), suffix in product(ALIASES.items(), POSITIONS.values()) if f"{name}_{suffix}" in out}
    return extra | out


def dot_table() -> dict[str, tuple[int, int]]:
    """Letter name to the dots expected above and below it."""
    out = {name: (above, below) for name, _, above, below in LETTERS} | OTHER_DOTS | dict.fromkeys(DIGITS, (0, 0))
    return {alias: out[name] for alias, name in ALIASES.items() if alias not in DOTLESS_ALIASES} | out


def label_rows() -> list[tuple[int, str, str, str | None, str, int | None, int | None]]:
    """(idx, label, base, position, glyph, above, below), by label; glyph has no joining strokes."""
    tags, dots = {v: k for k, v in POSITIONS.items()}, dot_table()
    out = []
    for idx, (label, char) in enumerate(sorted(label_table().items())):
        base, _, suffix = label.rpartition("_")
        base = base or label
        out.append((idx, label, base, tags.get(suffix), char.replace(TATWEEL, ""), *dots.get(base, (None, None))))
    return out


def label_dim(spark: SparkSession) -> DataFrame:
    """The label dimension: some hundreds of fixed rows, small enough to broadcast."""
    return spark.createDataFrame(label_rows(), "idx int, label string, base string, position string, glyph string, exp_above int, exp_below int")


def body_rows() -> list[tuple[str, int, int, str]]:
    return list(BODIES)


def body_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(body_rows(), "body string, above int, below int, letter string")
