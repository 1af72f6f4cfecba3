"""Labels of identity documents, corrections, countries and months."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Mapping
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

# Labels of each field in the order in which they are tried, one field after the other.
KEYWORDS: dict[str, tuple[str, ...]] = {
    "nom": (
        "nom", "vom", "nom/surname", "nom / surname", "nom d'usage", "nomdusage", "nomdusage1a", "surname", "surmame", "sumame",
        "family name", "last name", "name", "familienname", "nachname", "sobrenome", "nome", "apelido", "cognome", "mbiemri",
        "priezvisko", "surname/nom", "surmame/nom", "اللقب",
    ),
    "prenom": (
        "prenom", "prénom", "prenoms", "prénoms", "first name", "given name", "given names", "given name(s)",
        "first and middle names", "vorname", "vornamen", "nome do titular", "primeiro nome", "emri", "meno", "given name",
        "forenames", "voornamen", "الاسم",
    ),
    "date_naissance": (
        "date de naissance", "date naissance", "datedenaisso", "birth date", "date of birth", "date.of birth", "date ofbirth", "dob",
        "geburtsdatum", "geboren", "data de nascimento", "nascimento", "data nasc", "dute depalpance", "date depalpance",
        "datelindja", "datélindia", "datum narodenia", "date of birth/date de naissance", "date.ofbirth/date de naissance",
        "dateofbirth", "date.ofbirth", "تاريخ الولادة",
    ),
    "lieu_naissance": (
        "lieu de naissance", "lieudenaissance", "place of birth", "birth place", "city of birth", "geburtsort",
        "local de nascimento", "naturalidade", "vendlindja", "place of birth/lieu de naissance", "place.of birth", "مكانها",
        "مكان الولادة",
    ),
    "nationalite": (
        "nationalite", "nationalité", "nationite", "nationality", "citizenship", "staatsangehörigkeit", "nationalität",
        "nacionalidade", "shtetesia", "statne obcianstvo", "nationality/national", "nationality/nationalite",
    ),
    "numero_document": (
        "numero document", "numéro document", "n° document", "n° du document", "no document", "ndudocumento", "ndudoclment",
        "ndudoclmentloeno", "document number", "passport number", "passport no", "id number", "card no", "book number",
        "pass/passport", "pass passport", "reisepassnummer", "ausweisnummer", "dokumentennummer", "pass-nr",
        "numero do passaporte", "número do passaporte", "no do passaporte", "rne", "nr leternjoftim", "nr personal", "cislo",
        "passport/passeport", "pass/passeport", "identity no", "identity number", "id no", "identityno", "dentityno",
        "dentity no", "رقم بطاقة التعريف", "رقم بطاقة التعريف الوطنية", "بطاقة تعريف",
    ),
    "date_delivrance": (
        "date de délivrance", "date de delivrance", "date of issue", "issue date", "date issued", "issued", "ausstellungsdatum",
        "ausgestellt am", "data de emissao", "data de emissão", "emissao", "data de expedicao", "datadeexpedicao",
        "data e leshimit", "dataleshimit", "datum vydania", "date of issue/date de delivrance", "date.of issue", "dateofissue",
        "daleossue", "daleossue/date de devranc", "date de devranc", "تاريخ الاصدار", "تاريخ الإصدار",
    ),
    "date_expiration": (
        "date d'expiration", "date expiration", "dateexpir", "date of expiry", "expiry date", "expiration date",
        "date of expiration", "date of expiry/date d'expiration", "ablaufdatum", "gültig bis", "gultig bis", "data de validade",
        "validade", "data validade", "dae drplration", "data e skadimit", "datum platnosti", "date of expiry/date d expire",
        "deteof expiry", "dateof expiry", "date of expiry/dated expire", "deteof expiry/dated'expire",
    ),
    "sexe": ("sexe", "sex", "gender", "geschlecht", "sexo", "pohlavie", "gjinia", "الجنس"),
    "adresse": (
        "adresse", "address", "permanent address", "home address", "residence", "adresse", "wohnort", "endereco", "endereço",
        "adresa", "العنوان",
    ),
}

# Phrases to which recognised text is corrected.
CORRECTIONS: tuple[str, ...] = (
    "nom", "surname", "family name", "last name", "familienname", "sobrenome", "prenom", "prénom", "given name", "given names",
    "first name", "forenames", "vorname", "nationalite", "nationalité", "nationality", "citizenship", "sexe", "sex", "gender",
    "date de naissance", "date of birth", "birth date", "dob", "date expiration", "date d'expiration", "date of expiry",
    "expiry date", "document number", "passport number", "numero document", "identity number",
)

# Nationality by ISO code; name lines know all, data lines the first six.
COUNTRIES: dict[str, str] = {
    "USA": "AMÉRICAINE", "CHE": "SUISSE", "BRA": "BRÉSILIENNE", "FRA": "FRANÇAISE", "DEU": "ALLEMANDE", "GBR": "BRITANNIQUE",
    "ESP": "ESPAGNOLE", "ITA": "ITALIENNE", "PRT": "PORTUGAISE", "BEL": "BELGE", "NLD": "NÉERLANDAISE", "CAN": "CANADIENNE",
    "AUS": "AUSTRALIENNE", "MAR": "MAROCAINE", "ALB": "ALBANAISE", "ZAF": "SUD-AFRICAINE", "TUN": "TUNISIENNE", "DZA": "ALGÉRIENNE",
    "EGY": "ÉGYPTIENNE", "SEN": "SÉNÉGALAISE", "CIV": "IVOIRIENNE", "CMR": "CAMEROUNAISE", "MLI": "MALIENNE", "NER": "NIGÉRIENNE",
    "BFA": "BURKINABÈ", "GIN": "GUINÉENNE", "COD": "CONGOLAISE", "MDG": "MALGACHE", "MUS": "MAURICIENNE", "RWA": "RWANDAISE",
    "MEX": "MEXICAINE", "ARG": "ARGENTINE", "COL": "COLOMBIENNE", "IND": "INDIENNE", "CHN": "CHINOISE", "JPN": "JAPONAISE",
    "RUS": "RUSSE", "TUR": "TURQUE", "PAK": "PAKISTANAISE",
}
DATA_LINE_COUNTRIES = {k: COUNTRIES[k] for k in ("USA", "CHE", "BRA", "FRA", "DEU", "GBR")}

MONTHS = {m: f"{k:02d}" for k, m in enumerate(("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"), 1)}

#: The fields of a result in the order of a result file.
FIELDS = tuple(KEYWORDS)
MANDATORY = ("nom", "prenom", "numero_document", "nationalite")
MAIN = (*MANDATORY, "date_naissance")
DATES = ("date_naissance", "date_delivrance", "date_expiration")
#: Fields in which a longer value takes the place of a shorter one.
LONGEST = ("lieu_naissance", "sexe", "adresse")

# What a value of a field looks like.
VALIDATORS: dict[str, str] = {
    "nom": r"^[A-ZÀÂÄÉÈÊËÎÏÔÙÛÜÇ\u0600-\u06FF][a-zA-ZÀÂÄÉÈÊËÎÏÔÙÛÜÇàâäéèêëîïôùûüç\-\s'\u0600-\u06FF]{1,40}$",
    "prenom": r"^[A-ZÀÂÄÉÈÊËÎÏÔÙÛÜÇ\u0600-\u06FF][a-zA-ZÀÂÄÉÈÊËÎÏÔÙÛÜÇàâäéèêëîïôùûüç,\-\s'\u0600-\u06FF]{1,40}$",
    "nationalite": r"^(?!.*nationalit)(?!.*nacionalidad)(?!.*nationality)[a-zA-ZÀ-ÿ\s/\-]{3,30}$",
    "date_naissance": r"^\d{1,2}[\.\-\/\s]+\d{1,2}[\.\-\/\s]+\d{2,4}$|^\d{8}$|^\d{1,2}[\s]*[A-Za-z]{3}(?:/[A-Za-z]{3})?[\s]*\d{4}$",
    "lieu_naissance": r"^[a-zA-ZÀ-ÿ\-\s\,\.\u0600-\u06FF]{2,40}$",
    "date_delivrance": r"^\d{1,2}[\.\-\/\s]+\d{1,2}[\.\-\/\s]+\d{2,4}$|^\d{8}$|^\d{1,2}[\s]*[A-Za-z]{3}(?:/[A-Za-z]{3})?[\s]*\d{4}$",
    "date_expiration": r"^\d{1,2}[\.\-\/\s]+\d{1,2}[\.\-\/\s]+\d{2,4}$|^\d{8}$|^\d{1,2}[\s]*[A-Za-z]{3}(?:/[A-Za-z]{3})?[\s]*\d{4}$",
    "numero_document": r"^[A-Z0-9]{6,15}$",
    "sexe": r"^[MF]$",
    "adresse": r"^[a-zA-Z0-9À-ÿ\-\s\,\.\u0600-\u06FF]{5,100}$",
}
#: Fields whose pattern ignores case.
ANY_CASE = ("nationalite", "lieu_naissance", "sexe", "adresse")


@lru_cache(maxsize=65536)
def normalize(text: str) -> str:
    """Words of a label: camel case apart, lower case, no accents, only a-z, 0-9, Arabic and single spaces."""
    apart = unicodedata.normalize("NFD", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text).lower())
    bare = "".join(c for c in apart if unicodedata.category(c) != "Mn")
    return " ".join(re.sub(r"[^a-z0-9؀-ۿ\s]", " ", bare).split())


def keywords(spark: SparkSession, given: Mapping[str, list[str]] | None = None) -> DataFrame:
    """(field_ord, kw_ord, field, keyword, kw_norm, kw_words, kw_rare) of the dictionary given; our own has 194 rows, so it may be broadcast.

    kw_rare: of the keyword's words the one that fewest keywords have, null without words.
    """
    rows = [(i, j, field, k, normalize(k), normalize(k).split()) for i, (field, ks) in enumerate((given or KEYWORDS).items()) for j, k in enumerate(ks)]
    having = Counter(w for *_, words in rows for w in set(words))
    rows = [(*r, min(r[-1], key=lambda w: (having[w], -len(w), w), default=None)) for r in rows]
    return spark.createDataFrame(rows, "field_ord int, kw_ord int, field string, keyword string, kw_norm string, kw_words array<string>, kw_rare string")


def corrections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(CORRECTIONS)), "ord int, keyword string")
