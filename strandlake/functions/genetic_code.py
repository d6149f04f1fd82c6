"""Genetic codes as lookup tables. Codes, stop codons and alternative starts by table number."""

from __future__ import annotations

# The standard code, codons in order of bases T C A G.
_BASES = "TCAG"
_STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
STANDARD = {a + b + c: _STANDARD[16 * i + 4 * j + k] for i, a in enumerate(_BASES) for j, b in enumerate(_BASES) for k, c in enumerate(_BASES)}
# Codons whose third base does not matter.
FOURFOLD = {"GCN": "A", "GGN": "G", "CTN": "L", "CCN": "P", "CGN": "R", "TCN": "S", "ACN": "T", "GTN": "V"}
# What each table changes in the standard code.
CHANGES = {
    1: "", 2: "TGA=W AGA=* AGG=* ATA=M", 3: "TGA=W CTA=T CTC=T CTG=T CTT=T CTN=T ATA=M", 4: "TGA=W", 5: "TGA=W AGA=S AGG=S ATA=M",
    6: "TAA=Q TAG=Q", 9: "TGA=W AAA=N AGA=S AGG=S", 10: "TGA=C", 11: "", 12: "CTG=S", 13: "TGA=W AGA=G AGG=G ATA=M",
    14: "TAA=Y TGA=W AGA=S AGG=S AAA=N", 15: "TAG=Q", 16: "TAG=L", 21: "TGA=W AGA=S AGG=S ATA=M AAA=N", 22: "TCA=* TAG=L", 23: "TTA=*",
    24: "TGA=W AGA=S AGG=K", 25: "TGA=G", 26: "CTG=A", 27: "", 28: "", 29: "TAA=Y TAG=Y", 30: "TAA=E TAG=E", 31: "TGA=W", 33: "TAA=Y TGA=W AGA=S AGG=K",
}
# Stop codons of each table; the unknown codon NNN stops in all of them.
STOPS = {
    1: "TAA TAG TGA", 2: "TAA TAG AGA AGG", 3: "TAA TAG", 4: "TAA TAG", 5: "TAA TAG", 6: "TGA", 9: "TAA TAG", 10: "TAA TAG", 11: "TAA TAG TGA",
    12: "TAA TAG TGA", 13: "TAA TAG", 14: "TAG", 15: "TAA TGA", 16: "TAA TGA", 21: "TAA TAG", 22: "TCA TAA TGA", 23: "TTA TAA TAG TGA",
    24: "TAA TAG", 25: "TAA TAG", 26: "TAA TAG TGA", 27: "TGA", 28: "TAA TAG TGA", 29: "TGA", 30: "TGA", 31: "TAA TAG", 33: "TAG",
}
# Tables in which a codon besides ATG can start.
STARTS = {"CTG": (1, 4, 11, 12, 24, 26), "TTG": (1, 4, 5, 11, 13, 24, 25), "ATA": (2, 3, 4, 5, 13, 21), "ATT": (2, 4, 5, 11, 23), "ATC": (2, 5), "GTG": (2, 4, 5, 9, 11, 13, 21, 23, 24, 25)}
TABLES = tuple(CHANGES)


def residues(table: int) -> dict[str, str]:
    """codon -> residue; a codon that is not here is X."""
    return STANDARD | FOURFOLD | dict(x.split("=") for x in CHANGES[table].split())


def stops(table: int) -> list[str]:
    return sorted([*STOPS[table].split(), "NNN"])


def starts(table: int, alternative: bool = False) -> list[str]:
    return sorted(["ATG", *(c for c, t in STARTS.items() if alternative and table in t)])


def describe(table: int) -> str:
    if table not in CHANGES:
        raise ValueError(f"no translation table {table}")
    return f"table {table}: {CHANGES[table] or 'standard code'}; stops {STOPS[table]}"
