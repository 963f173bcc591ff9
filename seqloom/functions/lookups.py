"""Alphabets, letter classes and published property scales.

Everything here must equal the published tables, so the values are written out.
Any of them can be replaced by a table the caller reads (`sources.tables`).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The 20 letters in alphabetical order.
LETTERS = "ACDEFGHIKLMNPQRSTVWY"

# The letter order of the published property rows below.
ROW_ORDER = "ARNDCQEGHILKMFPSTWYV"

# Property rows of the pseudo composition, in ROW_ORDER.
PSEUDO_ROWS = {
    "Hydrophobicity": "0.62 -2.53 -0.78 -0.9 0.29 -0.85 -0.74 0.48 -0.4 1.38 1.06 -1.5 0.64 1.19 0.12 -0.18 -0.05 0.81 0.26 1.08",
    "Hydrophilicity": "-0.5 3 0.2 3 -1 0.2 3 0 -0.5 -1.8 -1.8 3 -1.3 -2.5 0 0.3 -0.4 -3.4 -2.3 -1.5",
    "SideChainMass": "15 101 58 59 47 72 73 1 82 57 57 73 75 91 42 31 45 130 107 43",
}

# Hydropathy of Kyte and Doolittle, in ROW_ORDER.
HYDROPATHY = "1.8 -4.5 -3.5 -3.5 2.5 -3.5 -3.5 -0.4 -3.2 4.5 3.8 -3.9 1.9 2.8 -1.6 -0.8 -0.7 -0.9 -1.3 4.2"

# Average residue masses and the mass of the water at the ends, in ROW_ORDER.
RESIDUE_MASS = (
    "71.0788 156.1875 114.1038 115.0886 103.1388 128.1307 129.1155 57.0519 137.1411 113.1594 "
    "113.1594 128.1741 131.1926 147.1766 97.1167 87.0782 101.1051 186.2132 163.1760 99.1326"
)
WATER_MASS = 18.0153

# Five z-scales per letter.
ZSCALES = {
    "A": (0.24, -2.32, 0.60, -0.14, 1.30),
    "C": (0.84, -1.67, 3.71, 0.18, -2.65),
    "D": (3.98, 0.93, 1.93, -2.46, 0.75),
    "E": (3.11, 0.26, -0.11, -0.34, -0.25),
    "F": (-4.22, 1.94, 1.06, 0.54, -0.62),
    "G": (2.05, -4.06, 0.36, -0.82, -0.38),
    "H": (2.47, 1.95, 0.26, 3.90, 0.09),
    "I": (-3.89, -1.73, -1.71, -0.84, 0.26),
    "K": (2.29, 0.89, -2.49, 1.49, 0.31),
    "L": (-4.28, -1.30, -1.49, -0.72, 0.84),
    "M": (-2.85, -0.22, 0.47, 1.94, -0.98),
    "N": (3.05, 1.62, 1.04, -1.15, 1.61),
    "P": (-1.66, 0.27, 1.84, 0.70, 2.00),
    "Q": (1.75, 0.50, -1.44, -1.34, 0.66),
    "R": (3.52, 2.50, -3.50, 1.99, -0.17),
    "S": (2.39, -1.07, 1.15, -1.39, 0.67),
    "T": (0.75, -2.18, -1.12, -1.46, -0.40),
    "V": (-2.59, -2.64, -1.54, -0.85, -0.02),
    "W": (-4.36, 3.94, 0.59, 3.44, -1.59),
    "Y": (-2.54, 2.44, 0.43, 0.04, -1.47),
}

# Number of codons per letter (61 in all).
CODONS = {
    "A": 4, "C": 2, "D": 2, "E": 2, "F": 2, "G": 4, "H": 2, "I": 3, "K": 2, "L": 6,
    "M": 1, "N": 2, "P": 4, "Q": 2, "R": 6, "S": 6, "T": 4, "V": 4, "W": 1, "Y": 2,
}

# The five-way and the seven-way letter grouping.
FIVE_GROUPS = {
    "alphaticr": "GAVLMI",
    "aromatic": "FYW",
    "postivecharger": "KRH",
    "negativecharger": "DE",
    "uncharger": "STCPNQ",
}
SEVEN_GROUPS = {
    "g1": "AGV", "g2": "ILFP", "g3": "YMTS", "g4": "HNQW", "g5": "RK", "g6": "DE", "g7": "C",
}

# Three-way classes used by the transition and distribution descriptors.
THREE_CLASSES = {
    "charge": ("KR", "ANCQGHILMFPSTWYV", "DE"),
    "hydrophobicity_ARGP820101": ("QSTNGDE", "RAHCKMV", "LYPFIW"),
    "hydrophobicity_FASG890101": ("KERSQD", "NTPG", "AYHWVMFLIC"),
    "normwaalsvolume": ("GASTPDC", "NVEQIL", "MHKFRYW"),
    "solventaccess": ("ALFCGIVW", "RKQEND", "MSPTHY"),
}

# pK of the ionizable letters and of the two ends (Lehninger).
PK_POSITIVE = {"n_end": 9.69, "K": 10.53, "R": 12.48, "H": 6.00}
PK_NEGATIVE = {"c_end": 2.34, "D": 3.65, "E": 4.25, "C": 8.18, "Y": 10.07}

# Grantham's distances between letters, upper triangle in ROW_ORDER.
GRANTHAM_UPPER = """
112 111 126 195 91 107 60 86 94 96 106 84 113 27 99 58 148 112 64
86 96 180 43 54 125 29 97 102 26 91 97 103 110 71 101 77 96
23 139 46 42 80 68 149 153 94 142 158 91 46 65 174 143 133
154 61 45 94 81 168 172 101 160 177 108 65 85 181 160 152
154 170 159 174 198 198 202 196 205 169 112 149 215 194 192
29 87 24 109 113 53 101 116 76 68 42 130 99 96
98 40 134 138 56 126 140 93 80 65 152 122 121
98 135 138 127 127 153 42 56 59 184 147 109
94 99 32 87 100 77 89 47 115 83 84
5 102 10 21 95 142 89 61 33 29
107 15 22 98 145 92 61 36 32
95 102 103 121 78 110 85 97
28 87 135 81 67 36 21
114 155 103 40 22 50
74 38 147 110 68
58 177 144 124
128 92 69
37 88
55
"""


def _row(text: str) -> dict[str, float]:
    return dict(zip(ROW_ORDER, (float(v) for v in text.split())))


def property_rows() -> dict[str, dict[str, float]]:
    """The three property rows as ``{property: {letter: value}}``."""
    return {name: _row(text) for name, text in PSEUDO_ROWS.items()}


def hydropathy() -> dict[str, float]:
    return _row(HYDROPATHY)


def residue_masses() -> dict[str, float]:
    return _row(RESIDUE_MASS)


def standardized(row: dict[str, float]) -> dict[str, float]:
    """Subtract the mean over the 20 letters, divide by their population deviation."""
    mean = sum(row.values()) / len(row)
    sd = math.sqrt(sum((v - mean) ** 2 for v in row.values()) / len(row))
    return {letter: (v - mean) / sd for letter, v in row.items()}


def standardized_rows() -> dict[str, dict[str, float]]:
    return {name: standardized(row) for name, row in property_rows().items()}


def grantham() -> dict[tuple[str, str], float]:
    """The symmetric distance table, zero on the diagonal."""
    table = {(a, a): 0.0 for a in ROW_ORDER}
    for i, line in enumerate(GRANTHAM_UPPER.strip().splitlines()):
        for j, value in enumerate(line.split(), start=i + 1):
            a, b = ROW_ORDER[i], ROW_ORDER[j]
            table[a, b] = table[b, a] = float(value)
    return table


def similarity_scores() -> dict[tuple[str, str], float]:
    """The default substitution score: 100 minus the distance, so identity scores most.

    A caller with a substitution matrix of its own passes that one instead.
    """
    return {pair: 100.0 - d for pair, d in grantham().items()}


def group_of(groups: dict[str, str]) -> dict[str, str]:
    return {letter: name for name, members in groups.items() for letter in members}


def recode(seq: Column, classes: list[str] | tuple[str, ...]) -> Column:
    """Replace each letter by the digit of its class: '1' for the first class, and so on."""
    source = "".join(classes)
    target = "".join(str(i) * len(members) for i, members in enumerate(classes, start=1))
    return F.translate(seq, source, target)


def array_literal(numbers, kind: str = "double") -> Column:
    """A constant array, written as one string that the optimizer folds."""
    return F.split(F.lit(",".join(repr(v) for v in numbers)), ",").cast(f"array<{kind}>")


def by_letter_code(row: dict[str, float]) -> Column:
    """An array literal indexed by ``ascii(letter) - 64``, for constant-time lookups."""
    return array_literal(float(row.get(chr(64 + i), 0.0)) for i in range(1, 27))


def letter_table(spark: SparkSession, rows: dict[str, dict[str, float]]) -> DataFrame:
    """``(prop, letter, value)``; at most 20 rows per property, so it may be broadcast."""
    data = [(p, a, float(v)) for p, row in rows.items() for a, v in row.items()]
    return spark.createDataFrame(data, "prop string, letter string, value double")


def pair_table(spark: SparkSession, values: dict[tuple[str, str], float]) -> DataFrame:
    """``(token, value)`` for the 400 letter pairs."""
    data = [(a + b, float(v)) for (a, b), v in values.items()]
    return spark.createDataFrame(data, "token string, value double")
