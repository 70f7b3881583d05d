"""A dictionary of interchangeable search terms, as data: groups of terms, from here or from a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Countries; words with and without their marks, and what they are called elsewhere; organisations.
GROUPS = [
    ["mısır", "misir", "egypt"], ["nijerya", "nigeria"], ["gana", "ghana"], ["etiyopya", "etiopia", "ethiopia"], ["fas", "morocco"], ["fildişi sahili", "fildisi sahili", "ivory coast", "cote d ivoire"],
    ["güney afrika", "guney afrika", "south africa"], ["tanzanya", "tanzania"], ["mozambik", "mozambique"], ["zimbabve", "zimbabwe"], ["namibya", "namibia"], ["botsvana", "botswana"], ["zambiya", "zambia"],
    ["tunus", "tunisia"], ["cezayir", "algeria"], ["demokratik kongo", "dr kongo", "drc", "kongo"], ["somali", "somalia"], ["madagaskar", "madagascar"], ["liberya", "liberia"], ["güney sudan", "guney sudan", "south sudan"],
    ["eritre", "eritrea"], ["kamerun", "cameroon"], ["angola", "angola"], ["ruanda", "rwanda"], ["burundi", "burundi"], ["uganda", "uganda"], ["kenya", "kenya"], ["senegal", "senegal"], ["mali", "mali"], ["nijer", "niger"],
    ["gabon", "gabon"], ["togo", "togo"], ["benin", "benin"], ["sudan", "sudan"], ["libya", "libya"], ["sierra leone", "sierra leone"], ["gambiya", "gambia"],
    ["altın", "altin", "gold"], ["tarım", "tarim", "agriculture"], ["enerji", "energy"], ["maden", "madencilik", "mining", "mineral"], ["seçim", "secim", "election", "sandık", "oy", "vote"], ["darbe", "coup"],
    ["ekonomi", "economy"], ["yatırım", "yatirim", "investment"], ["ticaret", "trade"], ["ihracat", "export"], ["ithalat", "import"], ["savunma", "defense", "defence"], ["göç", "goc", "migration"],
    ["petrol", "oil", "petroleum"], ["doğalgaz", "dogalgaz", "natural gas"], ["güvenlik", "guvenlik", "security"], ["kalkınma", "kalkinma", "development"], ["altyapı", "altyapi", "infrastructure"],
    ["liman", "port", "harbour"], ["demiryolu", "railway", "railroad"], ["banka", "bank"], ["finans", "finance"], ["borç", "borc", "debt"], ["sağlık", "saglik", "health"], ["eğitim", "egitim", "education"],
    ["turizm", "tourism"], ["tekstil", "textile"], ["çimento", "cimento", "cement"], ["konut", "housing"], ["gayrimenkul", "real estate"],
    ["afrika birliği", "african union", "au"], ["dünya bankası", "dunya bankasi", "world bank"], ["para fonu", "imf", "international monetary fund"], ["brics", "brics"], ["ecowas", "ecowas", "batı afrika topluluğu"],
    ["sadc", "sadc"], ["comesa", "comesa"], ["afreximbank", "afreximbank"], ["afdb", "africa development bank", "afrika kalkınma bankası"],
]

#: A dictionary is read by the driver: a table of more groups than this is refused.
MOST_GROUPS = 100_000


def groups_from(rows: DataFrame, group: str = "group", term: str = "term") -> list[list[str]]:
    """Groups of a table (group, term), in the order of their groups; for ``operators.search.synonym_table``."""
    found = rows.groupBy(group).agg(F.array_sort(F.collect_set(term)).alias("terms")).orderBy(group).limit(MOST_GROUPS + 1).collect()
    if len(found) > MOST_GROUPS:
        raise ValueError(f"a dictionary of more than {MOST_GROUPS} groups")
    return [list(r["terms"]) for r in found]
