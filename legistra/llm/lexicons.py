"""Lexicons for comparing questions; a caller may pass its own."""

from __future__ import annotations

from legistra.llm.cross_split import Lexicon

# Phrases that add nothing, words of the same meaning, and words that may come and go.
FILLER = (
    "mohon pencerahannya", "mohon dijelaskan", "terima kasih", "izin bertanya", "tolong tanya", "halo min",
    "saya ingin tahu", "butuh cepat", "makasih", "permisi",
)
SAME = {
    "yg": "yang", "tdk": "tidak", "utk": "untuk", "dgn": "dengan", "dlm": "dalam", "pd": "pada", "kpd": "kepada",
    "thn": "tahun", "no": "nomor", "dr": "dari", "krn": "karena", "sblm": "sebelum", "tsb": "tersebut", "dg": "dengan",
    "bgmn": "bagaimana", "jg": "juga", "sdh": "sudah", "blm": "belum", "hrs": "harus", "spt": "seperti",
    "gimana": "bagaimana", "kenapa": "mengapa", "apakah": "apa", "bilamana": "kapan", "kalau": "jika", "bila": "jika",
    "berdasarkan": "menurut", "sesuai": "menurut", "berkuasa": "berwenang", "wajib": "harus", "senarai": "daftar",
    "membatalkan": "mencabut", "melunasi": "membayar", "ongkos": "biaya", "pelaporan": "laporan", "lokal": "setempat",
}
EITHER = {"memberikan": ("menyampaikan", "menyerahkan")}
LIGHT = frozenset("ya nih dong sih kok deh min yang apa dan itu ini pun lah kah saja aja".split())

INDONESIAN = Lexicon(
    FILLER, SAME, EITHER, LIGHT,
    ((r"&", " dan "), (r"selambat\s*-\s*lambatnya(?:\s+lambat)?", "paling lambat"), (r"\bpihak\s+mana\b", "siapa")),
)
