"""Column functions that clean, code and band clinical values. Nulls stay null unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NULL_TOKENS = ("", "NA", "NaN", "NULL", "null", "N/A", "n/a", "-", "--")
VISIT_MONTHS = {"bl": 0, "sc": 0, "baseline": 0, "screening": 0}
VISIT_NAMES = {"baseline": "bl", "screening": "sc", "scmri": "sc"}
APOE_RISK = (("4/4", 12.0), ("3/4", 3.0), ("2/4", 2.5), ("3/3", 1.0))
DIAGNOSIS_NUMBERS = {1: "CN", 2: "MCI", 3: "AD"}
DIAGNOSIS_NUMBERS_8 = {1: "CN", 2: "MCI", 3: "AD", 4: "MCI", 5: "AD", 6: "SMC", 7: "EMCI", 8: "LMCI"}
DIAGNOSIS_CODES = {"CN": "CN", "NL": "CN", "NORMAL": "CN", "CTL": "CN", "CONTROL": "CN", "HC": "CN", "MCI": "MCI", "EMCI": "EMCI", "LMCI": "LMCI", "AD": "AD", "DEMENTIA": "AD", "DEM": "AD", "ALZHEIMER": "AD", "SMC": "SMC", "SCD": "SMC"}
DIAGNOSIS_TEXTS = {"CN": "Cognitively Normal", "SMC": "Subjective Memory Concern", "EMCI": "Early Mild Cognitive Impairment", "LMCI": "Late Mild Cognitive Impairment", "MCI": "Mild Cognitive Impairment", "AD": "Alzheimer's Disease"}
ARM_WORDS = (("CN|CONTROL", "CN"), ("EMCI", "EMCI"), ("LMCI", "LMCI"), ("SMC", "SMC"), ("MCI", "MCI"), ("AD|ALZHEIMER", "AD"))
# least score of a band, or greatest score of a band; None for the rest
SCORE_BANDS = {
    "MMSE": ((27, "normal"), (21, "mild_impairment"), (10, "moderate_impairment"), (None, "severe_impairment")),
    "MOCA": ((26, "normal"), (18, "mild_impairment"), (None, "moderate_severe_impairment")),
}
RISING_BANDS = {
    "ADAS": ((10, "normal"), (20, "mild_impairment"), (40, "moderate_impairment"), (None, "severe_impairment")),
    "CDR": ((0, "normal"), (0.5, "questionable"), (1, "mild"), (2, "moderate"), (None, "severe")),
    "FAQ": ((3, "normal"), (9, "mild_impairment"), (None, "significant_impairment")),
}
RELATIONS = (
    ("MOTHER|MOM|FATHER|DAD|PARENT", "parent"), ("SIBLING|BROTHER|SISTER|SIB", "sibling"), ("CHILD|SON|DAUGHTER|OFFSPRING", "child"), ("AUNT|UNCLE|COUSIN", "other_relative"),
)
RELATIVE_SEXES = (("MOTHER|MOM", "F"), ("FATHER|DAD", "M"), ("SISTER", "F"), ("BROTHER", "M"), ("DAUGHTER", "F"), ("SON", "M"), ("AUNT", "F"), ("UNCLE", "M"))
DEMENTIA_TYPES = (("ALZH|AD", "Alzheimer's Disease"), ("VASCULAR", "Vascular Dementia"), ("LEWY", "Lewy Body Dementia"), ("FRONTOTEMPORAL|FTD", "Frontotemporal Dementia"), ("DEMENTIA", "Dementia (unspecified)"))
PET_TRACERS = (
    ("FDG|FLUORODEOXYGLUCOSE", "FDG"), ("AV45|FLORBETAPIR|AMYVID", "AV45"), ("FBB|FLORBETABEN", "FBB"), ("PIB|PITTSBURGH", "PIB"), ("AV1451|TAU|FLORTAUCIPIR", "AV1451"), ("AV133", "AV133"), ("MK6240", "MK6240"), ("RO-?948", "RO948"),
    ("GLUCOSE|METABOLIC", "FDG"), ("AMYLOID|PLAQUE", "AV45"), ("TANGLE", "AV1451"),
)
REGIONS = (
    ("hippo", "hippocampus"), ("cortex|cortical", "cortex"), ("ventricle|ventricular", "ventricles"), ("cerebellum", "cerebellum"), ("frontal", "frontal_lobe"), ("temporal", "temporal_lobe"), ("parietal", "parietal_lobe"), ("occipital", "occipital_lobe"), ("whole|brain", "whole_brain"),
)
# of a score map's scores (least of a band, None for the rest): the best MMSE, then the worst CDR sum of boxes, which counts where there is one
MMSE_SIGNIFICANCE = ((24, "normal"), (20, "mild_impairment"), (10, "moderate_impairment"), (None, "severe_impairment"))
CDR_SUM_SIGNIFICANCE = ((10, "severe_impairment"), (4.5, "moderate_impairment"), (0.5, "mild_impairment"), (None, "normal"))
BIOMARKER_SUBTYPES = ("csf_biomarker", "amyloid_biomarker", "tau_biomarker")
GENOTYPE_SIGNIFICANCE = (("4/4", "very_high_risk"), ("3/4|4/3", "high_risk"), ("2/4|4/2", "moderate_risk"), ("2/2|2/3", "protective"))
HIPPOCAMPUS_SIGNIFICANCE = ((4000, "normal"), (3500, "mild_atrophy"), (3000, "moderate_atrophy"), (None, "severe_atrophy"))
NAMESPACES = (
    ("ro:RO_", "RO"), ("http://purl.obolibrary.org/obo/RO_", "RO"), ("biolink:", "Biolink"), ("https://w3id.org/biolink/", "Biolink"), ("http://w3id.org/biolink/", "Biolink"), ("skos:", "SKOS"), ("http://www.w3.org/2004/02/skos/", "SKOS"), ("rdfs:", "RDFS"), ("http://www.w3.org/2000/01/rdf-schema#", "RDFS"),
    ("owl:", "OWL"), ("http://www.w3.org/2002/07/owl#", "OWL"), ("time:", "OWL-Time"), ("http://www.w3.org/2006/time#", "OWL-Time"), ("http://purl.obolibrary.org/obo/", "OBO"), ("cohort:", "internal"),
)


def cases(pairs: list[tuple[Column, object]], otherwise=None) -> Column:
    """The value of the first condition that holds."""
    out = reduce(lambda c, p: F.when(*p) if c is None else c.when(*p), pairs, None)
    return out.otherwise(otherwise)


def lookup(c: Column, table: dict[str, object]) -> Column:
    """The table's value for c; null without one."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c) if table else F.lit(None)


def clean_string(c: Column, limit: int = 10_000) -> Column:
    """Trimmed, without NUL and characters beyond the basic plane, cut at limit with dots after it."""
    s = F.regexp_replace(F.regexp_replace(c, r"[\x{0}\x{10000}-\x{10FFFF}]", ""), r"^\s+|\s+$", "")
    return F.when(F.char_length(s) > limit, F.concat(F.substring(s, 1, limit), F.lit("..."))).otherwise(s)


def null_tokens(c: Column) -> Column:
    return F.when(~F.trim(c).isin(*NULL_TOKENS), c)


def clean_numeric(c: Column) -> Column:
    """Text to double without commas, dollar and percent signs; tokens for null, NaN and infinities are null."""
    n = F.regexp_replace(F.trim(null_tokens(c)), "[,$%]", "").try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def valid_patient_id(c: Column, excluded: tuple[str, ...] = ("381_S_",)) -> Column:
    return c.rlike(r"^\d{3}_S_\d{4}$") & ~reduce(lambda a, b: a | b, [c.startswith(p) for p in excluded])


def valid_visit_code(c: Column) -> Column:
    v = F.lower(F.trim(c))
    return v.isin(*VISIT_MONTHS) | v.startswith("m")


def normalize_viscode(c: Column) -> Column:
    """month N and year N (however spelled) as mNN, at least two digits; baseline, screening and scmri as bl and sc; other codes in lower case."""
    v = F.lower(F.trim(c))
    n = F.regexp_extract(v, r"(\d+)", 1).try_cast("int")
    months = F.when(v.startswith("month"), n).when(v.startswith("year"), n * 12)
    return F.coalesce(lookup(v, VISIT_NAMES), F.when(months.isNotNull(), F.format_string("m%02d", months)), v)


def viscode_to_months(c: Column) -> Column:
    """bl and sc 0, mN N, yN 12 N, else the first number, else 0."""
    v = F.lower(F.trim(c))
    n = F.coalesce(F.regexp_extract(v, r"(\d+)", 1).try_cast("int"), F.lit(0))
    return cases([(v.isin(*VISIT_MONTHS, *VISIT_NAMES), F.lit(0)), (v.rlike(r"^y\d+"), n * 12)], n)


def normalize_gender(c: Column) -> Column:
    v = F.upper(F.trim(c.cast("string")))
    return cases([(v.isin("M", "MALE", "1", "1.0"), F.lit("M")), (v.isin("F", "FEMALE", "2", "2.0"), F.lit("F"))])


def derive_age(age: Column, visit_date: Column, birth_year: Column, low: int = 40, high: int = 120) -> Column:
    """The given age, else visit year less birth year (a year, or mm/yyyy); null outside low..high."""
    born = F.regexp_extract(birth_year.cast("string"), r"(\d{4})$", 1).try_cast("int")
    a = F.coalesce(age.cast("int"), F.year(visit_date) - born)
    return F.when(a.between(low, high), a)


def compose_genotype(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(F.lit("E"), a.cast("string"), F.lit("/E"), b.cast("string")))


def count_allele(genotype: Column, allele: str = "4") -> Column:
    return F.size(F.filter(F.split(genotype, "/"), lambda p: p.endswith(allele)))


def genotype_risk(genotype: Column) -> Column:
    g = F.regexp_replace(genotype, "E", "")
    ordered = F.array_join(F.array_sort(F.split(g, "/")), "/")
    return cases([*[(ordered == k, F.lit(v)) for k, v in APOE_RISK], (ordered.isin("2/2", "2/3"), F.lit(0.6))], F.lit(1.0))


def _by_number(c: Column, numbers: dict[int, str]) -> Column:
    return cases([(c.try_cast("double") == n, F.lit(code)) for n, code in numbers.items()])


def _by_word(c: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The code of the first rule whose pattern the text holds."""
    return cases([(c.rlike(p), F.lit(code)) for p, code in rules])


def map_diagnosis(c: Column, numbers: dict[int, str] = DIAGNOSIS_NUMBERS) -> Column:
    """The code of a number, also written like 1.0, or of a diagnosis's name in any case; null for others. DIAGNOSIS_NUMBERS_8 are the eight numbers of the older form."""
    return F.coalesce(_by_number(c, numbers), lookup(F.upper(F.trim(c.cast("string"))), DIAGNOSIS_CODES))


def map_diagnosis_loosely(c: Column) -> Column:
    """Numbers 1 to 3, else by what the text holds: CN or NORMAL, MCI, AD or ALZHEIMER, in this order."""
    return F.coalesce(_by_number(c, DIAGNOSIS_NUMBERS), _by_word(F.upper(c.cast("string")), (("CN|NORMAL", "CN"), ("MCI", "MCI"), ("AD|ALZHEIMER", "AD"))))


def map_arm(c: Column) -> Column:
    """The first of ARM_WORDS that the text holds, else the code of a whole number from 1 to 3."""
    return F.coalesce(_by_word(F.upper(c.cast("string")), ARM_WORDS), cases([(c.try_cast("int") == n, F.lit(code)) for n, code in DIAGNOSIS_NUMBERS.items()]))


def abnormal_flag(value: Column, threshold: Column, direction: Column) -> Column:
    """Whether value lies beyond threshold in the direction low or high; false without threshold."""
    return F.coalesce(F.when(direction == "low", value < threshold).otherwise(value > threshold), F.lit(False))


def _least(score: Column, bands: tuple) -> Column:
    """The first band whose least score is reached; null for null."""
    return F.when(score.isNotNull(), cases([(score >= cut if cut is not None else F.lit(True), F.lit(word)) for cut, word in bands]))


def interpret_score(test: str, score: Column) -> Column:
    """The band of a score of MMSE, MoCA, ADAS-Cog, CDR or FAQ (in any case); unknown for other tests, null without a score."""
    name = test.upper().removesuffix("-COG")
    if name in SCORE_BANDS:
        return _least(score, SCORE_BANDS[name])
    bands = RISING_BANDS.get(name, ((None, "unknown"),))
    return F.when(score.isNotNull(), cases([(score <= cut if cut is not None else F.lit(True), F.lit(word)) for cut, word in bands]))


def score_to_diagnosis(mmse: Column) -> Column:
    return F.when(mmse.isNotNull(), cases([(mmse >= 27, F.lit("CN")), (mmse >= 21, F.lit("MCI"))], F.lit("AD")))


def cdr_to_diagnosis(cdr: Column) -> Column:
    """0 CN, up to 0.5 MCI, from 1 AD; nothing between."""
    return cases([(cdr == 0, F.lit("CN")), (cdr <= 0.5, F.lit("MCI")), (cdr >= 1, F.lit("AD"))])


def cdr_to_diagnosis_of_two(cdr: Column) -> Column:
    """The second cohort's rule: 0 CN, every other score AD."""
    return F.when(cdr.isNotNull(), F.when(cdr == 0, "CN").otherwise("AD"))


def is_family_column(name: Column) -> Column:
    """Whether a column's name holds a relative and a word of dementia, onset or age."""
    n = F.upper(name)
    return n.rlike("MOTHER|FATHER|MOM|DAD|PARENT|SIBLING|BROTHER|SISTER|SIB|CHILD|SON|DAUGHTER|OFFSPRING|FAMILY|RELATIVE") & n.rlike("DEM|ALZH|AD|MEMORY|COGNITIVE|ONSET|AGE")


def family_relation(name: Column) -> Column:
    """parent, sibling, child or other_relative by the first kind of word that a column's name holds (so GRANDMOTHER is a parent), else unknown; of FAMILY and RELATIVE the first degree is parent."""
    n = F.upper(name)
    general = F.when(n.rlike("FAMILY|RELATIVE"), F.when(n.rlike("1ST|FIRST"), "parent").otherwise("other_relative"))
    return F.when(n.isNotNull(), F.coalesce(_by_word(n, RELATIONS), general, F.lit("unknown")))


def relative_sex(name: Column) -> Column:
    return _by_word(F.upper(name), RELATIVE_SEXES)


def dementia_type(name: Column) -> Column:
    return _by_word(F.upper(name), DEMENTIA_TYPES)


def family_column(name: Column) -> Column:
    """relation of a family-history column name by its words; null for other columns."""
    n = F.upper(name)
    return cases([(n.rlike("MOTH|MOM"), F.lit("mother")), (n.rlike("FATH|DAD"), F.lit("father")), (n.rlike("SIB|BRO|SIS"), F.lit("sibling")), (n.rlike("CHILD|SON|DAUGH"), F.lit("child"))])


def indicates_dementia(c: Column) -> Column:
    """By a positive answer, also in numbers, or a word of dementia in the text."""
    v = F.lower(F.trim(c.cast("string")))
    return F.coalesce(v.isin("1", "2", "1.0", "2.0", "yes", "y", "true", "t") | v.rlike("dementia|alzheimer|ad|memory|cognitive|impair"), F.lit(False))


def bmi(weight: Column, pounds: Column, height: Column, inches: Column) -> Column:
    kg = F.when(pounds, weight * 0.453592).otherwise(weight)
    m = F.when(inches, height * 2.54).otherwise(height) / 100
    return F.when(m > 0, F.bround(kg / (m * m), 2))


def in_range(c: Column, low: float, high: float) -> Column:
    return F.when(c.between(low, high), c)


def flag_truthy(c: Column, yes: int = 1) -> Column:
    """The number ``yes``, also written like 1.0, or Y; everything else is not set."""
    return F.coalesce(F.coalesce(c.try_cast("double") == yes, F.lit(False)) | (F.upper(F.trim(c.cast("string"))) == "Y"), F.lit(False))


def parse_image_name(name: Column) -> Column:
    """struct(modality, series, study_date) of an underscore-separated file name; null under five parts."""
    parts = F.split(F.regexp_replace(name, r"\.\w+$", ""), "_")
    dates = F.filter(parts, lambda p: p.rlike(r"^\d{8}$"))
    middle = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    return F.when(F.size(parts) >= 5, F.struct(parts[0].alias("modality"), F.array_join(middle, "_").alias("series"), F.get(dates, 0).alias("study_date")))


def pet_tracer(*texts: Column) -> Column:
    """The tracer that the first of the texts names, series before file name, by name or by what it shows; null without one."""
    return F.coalesce(*[_by_word(F.upper(t), PET_TRACERS[:-3]) for t in texts], *[_by_word(F.upper(t), PET_TRACERS[-3:]) for t in texts])


def anatomical_region(c: Column, modality: Column) -> Column:
    """The first of REGIONS that the description holds, else whole_brain of a PET and brain of other modalities."""
    return F.coalesce(_by_word(F.lower(c), REGIONS), F.when(modality == "PET", "whole_brain").otherwise("brain"))


def region_of(c: Column, default: str = "whole brain") -> Column:
    u = F.lower(c)
    return cases([(u.contains("hippo"), F.lit("hippocampus")), (u.contains("entorh"), F.lit("entorhinal cortex")), (u.contains("ventric"), F.lit("ventricle"))], F.lit(default))


def path_identity(path: Column) -> Column:
    """struct(id, modality): subject id, else image number, else the parent folder; PET before MRI before CT."""
    none_if_empty = lambda x: F.when(x != "", x)
    who = F.coalesce(none_if_empty(F.regexp_extract(path, r"(\d{3}_S_\d{4})", 1)), none_if_empty(F.regexp_extract(path, r"(I\d{6})", 1)), none_if_empty(F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)))
    u = F.upper(path)
    return F.struct(who.alias("id"), cases([(u.contains(m), F.lit(m)) for m in ("PET", "MRI", "CT")], F.lit("unknown")).alias("modality"))


def normalize_curie(uri: Column, prefix: str) -> Column:
    """PREFIX:n of any form of the identifier."""
    n = F.regexp_extract(uri, rf"{prefix}[:_](\d+)", 1)
    return F.when(n != "", F.concat(F.lit(f"{prefix}:"), n))


def label_match(a: Column, b: Column, least: float = 0.5) -> Column:
    """Equal, one within the other, or the shared tokens at least that share of the smaller label's."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))
    x, y = norm(a), norm(b)
    words = lambda c: F.array_distinct(F.split(c, " "))
    share = F.size(F.array_intersect(words(x), words(y))) / F.least(F.size(words(x)), F.size(words(y)))
    return (x == y) | x.contains(y) | y.contains(x) | (share >= least)


def uri_namespace(uri: Column) -> Column:
    return F.when(uri.isNotNull(), cases([(uri.startswith(p), F.lit(n)) for p, n in NAMESPACES], F.lit("other")))


def age_group(age: Column) -> Column:
    return F.when(age.isNotNull(), cases([(age < 65, F.lit("<65")), (age < 75, F.lit("65-74")), (age < 85, F.lit("75-84"))], F.lit("85+")))


def bucket(c: Column, width: int) -> Column:
    return (F.floor(c / width) * width).cast("int")


def severity_of_scores(scores: Column) -> Column:
    """Severity from the largest score of a map whose key holds MMSE."""
    top = F.array_max(F.map_values(F.map_filter(scores, lambda k, _: F.upper(k).contains("MMSE"))))
    return F.when(top.isNotNull(), cases([(top >= 24, F.lit("none")), (top >= 18, F.lit("mild"))], F.lit("severe")))


def finding_significance(kind: Column, subtype: Column, scores: Column, values: Column, texts: Column) -> Column:
    """The clinical significance of a finding, by its kind; normal where no rule says else.

    psychometric: by the best score (a map) whose key holds MMSE, unless one holds CDR and SUM: then by
    the worst of those. biomarker of one of BIOMARKER_SUBTYPES: abnormal if a value (a map) is beyond its
    key's threshold. genetic: by the text (a map) whose key holds APOE. imaging of a volume: by the least
    value whose key holds HIPPO. Null values count for nothing.
    """
    best = lambda m, rule, pick: pick(F.filter(F.map_values(F.map_filter(m, lambda k, v: rule(F.upper(k)) & v.isNotNull())), lambda v: v.isNotNull()))
    mmse = best(scores, lambda k: k.contains("MMSE"), F.array_max)
    boxes = best(scores, lambda k: k.contains("CDR") & k.contains("SUM"), F.array_max)
    beyond = F.map_filter(values, lambda k, v: (F.upper(k).contains("ABETA42") & (v < 600)) | (F.upper(k).contains("TAU") & ~F.upper(k).contains("PTAU") & (v > 400)) | (F.upper(k).contains("PTAU") & (v > 80)))
    apoe = F.array_join(F.map_values(F.map_filter(texts, lambda k, v: F.upper(k).contains("APOE"))), " ")
    volume = best(values, lambda k: k.contains("HIPPO"), F.array_min)
    found = cases([
        (kind == "psychometric", F.coalesce(_least(boxes, CDR_SUM_SIGNIFICANCE), _least(mmse, MMSE_SIGNIFICANCE))), ((kind == "biomarker") & subtype.isin(*BIOMARKER_SUBTYPES), F.when(F.size(beyond) > 0, "abnormal")),
        (kind == "genetic", _by_word(apoe, GENOTYPE_SIGNIFICANCE)), ((kind == "imaging") & F.upper(subtype).contains("VOLUME"), _least(volume, HIPPOCAMPUS_SIGNIFICANCE)),
    ])
    return F.coalesce(found, F.lit("normal"))


def largest_side(resolution: Column) -> Column:
    """The larger of WxH."""
    side = lambda i: F.get(F.split(F.lower(resolution), "x"), i).try_cast("int")
    return F.greatest(side(0), side(1))
