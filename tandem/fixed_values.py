"""Word lists, code tables and character sets.

Results depend on these exact values, so they are stated as plain text in their
natural order. Nothing here is logic.
"""

import string

# The 24 languages by family, in planning order.
LANGUAGE_FAMILIES = {
    "English": ["en"],
    "Germanic": ["de", "nl", "sv", "da", "af"],
    "Romance": ["fr", "es", "it", "pt", "ro"],
    "Slavic": ["ru", "cs", "pl", "bg", "uk"],
    "Malayo-Polyn.": ["id", "jv", "ms", "tl"],
    "Others": ["ja", "zh", "ko", "vi"],
}
HUB = "en"

# Languages that connect families, in planning order.
BRIDGES = ["en", "de", "nl", "fr", "es", "ru", "cs", "id", "ja", "zh"]

# Additional pairs for the family with a single bridge.
EXTRA_PAIRS = [
    "de-ms", "fr-ms", "ru-ms", "vi-ms", "ja-ms", "zh-ms", "jv-ms",
    "ja-tl", "zh-tl", "vi-tl", "ru-tl", "fr-tl", "de-tl",
]

# The 41 languages of the hub-centred benchmark, hub first.
BENCHMARK_LANGUAGES = [
    "en", "bg", "so", "ca", "da", "be", "bs", "mt", "es", "uk", "am", "hi", "ro",
    "no", "ti", "de", "cs", "lb", "pt", "nl", "mr", "is", "ne", "ur", "oc",
    "ast", "ha", "sv", "kab", "gu", "ar", "fr", "ru", "it", "pl", "sr", "sd", "he", "af", "kn", "bn",
]

# Resource classes of the benchmark (high, medium, low, extremely low).
RESOURCE_CLASSES = {
    "h": ["en", "de", "nl", "fr", "es", "ru", "cs", "hi", "bn", "ar", "he"],
    "m": ["sv", "da", "it", "pt", "pl", "bg", "kn", "mr", "mt", "ha"],
    "l": ["af", "lb", "ro", "oc", "uk", "sr", "sd", "gu", "ti", "am"],
    "e": ["no", "is", "ast", "ca", "be", "bs", "ne", "ur", "kab", "so"],
}

# Benchmark languages the neural segment scorer supports.
SCORER_LANGUAGES = [
    "en", "bg", "so", "ca", "da", "be", "bs", "es", "uk", "am", "hi", "ro",
    "no", "de", "cs", "pt", "nl", "mr", "is", "ne", "ur",
    "ha", "sv", "gu", "ar", "fr", "ru", "it", "pl", "sr", "sd", "he", "af", "kn", "bn",
]

# Benchmark languages the language detector supports.
DETECTOR_LANGUAGES = [
    "en", "bg", "da", "es", "uk", "hi", "ro", "de", "cs", "pt",
    "nl", "mr", "ur", "sv", "gu", "ar", "fr", "ru", "it", "pl",
    "he", "kn", "bn", "be", "mt", "am", "is", "sd",
]

# Metric name -> the word that marks its score line in a metric log,
# and the 1-based ':'-separated field the score stands in.
METRIC_KEYS = {
    "spbleu": ("score", 3),
    "chrf": ("score", 3),
    "comet": ("Score", 2),
    "offtarget": ("Ratio", 2),
}

# Language name | two/three-letter code | script-qualified code ("-" = none).
LANGUAGE_CODES = """
Afrikaans|af|afr_Latn
Danish|da|dan_Latn
Dutch|nl|nld_Latn
German|de|deu_Latn
English|en|eng_Latn
Icelandic|is|isl_Latn
Luxembourgish|lb|ltz_Latn
Norwegian|no|nob_Latn
Swedish|sv|swe_Latn
Frisian|fy|-
Yiddish|yi|ydd_Hebr
Asturian|ast|ast_Latn
Catalan|ca|cat_Latn
French|fr|fra_Latn
Galician|gl|glg_Latn
Italian|it|ita_Latn
Occitan|oc|oci_Latn
Portuguese|pt|por_Latn
Romanian|ro|ron_Latn
Spanish|es|spa_Latn
Belarusian|be|bel_Cyrl
Bosnian|bs|bos_Latn
Bulgarian|bg|bul_Cyrl
Croatian|hr|hrv_Latn
Czech|cs|ces_Latn
Macedonian|mk|mkd_Cyrl
Polish|pl|pol_Latn
Russian|ru|rus_Cyrl
Serbian|sr|srp_Cyrl
Slovak|sk|slk_Latn
Slovenian|sl|slv_Latn
Ukrainian|uk|ukr_Cyrl
Estonian|et|est_Latn
Finnish|fi|fin_Latn
Hungarian|hu|hun_Latn
Latvian|lv|lvs_Latn
Lithuanian|lt|lit_Latn
Albanian|sq|als_Latn
Armenian|hy|hye_Armn
Georgian|ka|kat_Geor
Greek|el|ell_Grek
Breton|br|-
Irish|ga|gle_Latn
Scottish Gaelic|gd|gla_Latn
Welsh|cy|cym_Latn
Azerbaijani|az|azj_Latn
Bashkir|ba|bak_Cyrl
Kazakh|kk|kaz_Cyrl
Turkish|tr|tur_Latn
Uzbek|uz|uzn_Latn
Japanese|ja|jpn_Jpan
Korean|ko|kor_Hang
Vietnamese|vi|vie_Latn
Chinese|zh|zho_Hans
Bengali|bn|ben_Beng
Gujarati|gu|guj_Gujr
Hindi|hi|hin_Deva
Kannada|kn|kan_Knda
Marathi|mr|mar_Deva
Nepali|ne|npi_Deva
Oriya|or|ory_Orya
Panjabi|pa|pan_Guru
Sindhi|sd|snd_Arab
Sinhala|si|sin_Sinh
Urdu|ur|urd_Arab
Tamil|ta|tam_Taml
Cebuano|ceb|ceb_Latn
Ilocano|ilo|ilo_Latn
Indonesian|id|ind_Latn
Javanese|jv|jav_Latn
Malagasy|mg|plt_Latn
Malay|ms|zsm_Latn
Malayalam|ml|mal_Mlym
Sundanese|su|sun_Latn
Tagalog|tl|tgl_Latn
Burmese|my|mya_Mymr
Khmer|km|khm_Khmr
Lao|lo|lao_Laoo
Thai|th|tha_Thai
Mongolian|mn|khk_Cyrl
Arabic|ar|arb_Arab
Hebrew|he|heb_Hebr
Pashto|ps|pbt_Arab
Persian|fa|pes_Arab
Amharic|am|amh_Ethi
Fulfulde|ff|fuv_Latn
Hausa|ha|hau_Latn
Igbo|ig|ibo_Latn
Lingala|ln|lin_Latn
Luganda|lg|lug_Latn
Northern Sotho|ns|nso_Latn
Somali|so|som_Latn
Swahili|sw|swh_Latn
Swati|ss|ssw_Latn
Tswana|tn|tsn_Latn
Wolof|wo|wol_Latn
Xhosa|xh|xho_Latn
Yoruba|yo|yor_Latn
Zulu|zu|zul_Latn
Haitian Creole|ht|hat_Latn
Kabyle|-|kab_Latn
Maltese|-|mlt_Latn
Tigrinya|-|tir_Ethi
Acehnese (Arabic script)|-|ace_Arab
Acehnese (Latin script)|-|ace_Latn
Mesopotamian Arabic|-|acm_Arab
Ta’izzi-Adeni Arabic|-|acq_Arab
Tunisian Arabic|-|aeb_Arab
South Levantine Arabic|-|ajp_Arab
Akan|-|aka_Latn
North Levantine Arabic|-|apc_Arab
Modern Standard Arabic (Romanized)|-|arb_Latn
Najdi Arabic|-|ars_Arab
Moroccan Arabic|-|ary_Arab
Egyptian Arabic|-|arz_Arab
Assamese|-|asm_Beng
Awadhi|-|awa_Deva
Central Aymara|-|ayr_Latn
Bambara|-|bam_Latn
Balinese|-|ban_Latn
Bemba|-|bem_Latn
Bhojpuri|-|bho_Deva
Banjar (Arabic script)|-|bjn_Arab
Banjar (Latin script)|-|bjn_Latn
Standard Tibetan|-|bod_Tibt
Buginese|-|bug_Latn
Chokwe|-|cjk_Latn
Central Kurdish|-|ckb_Arab
Crimean Tatar|-|crh_Latn
Southwestern Dinka|-|dik_Latn
Dyula|-|dyu_Latn
Dzongkha|-|dzo_Tibt
Esperanto|-|epo_Latn
Basque|-|eus_Latn
Ewe|-|ewe_Latn
Faroese|-|fao_Latn
Fijian|-|fij_Latn
Fon|-|fon_Latn
Friulian|-|fur_Latn
Guarani|-|grn_Latn
Chhattisgarhi|-|hne_Deva
Jingpho|-|kac_Latn
Kamba|-|kam_Latn
Kashmiri (Arabic script)|-|kas_Arab
Kashmiri (Devanagari script)|-|kas_Deva
Central Kanuri (Arabic script)|-|knc_Arab
Central Kanuri (Latin script)|-|knc_Latn
Kabiyè|-|kbp_Latn
Kabuverdianu|-|kea_Latn
Kikuyu|-|kik_Latn
Kinyarwanda|-|kin_Latn
Kyrgyz|-|kir_Cyrl
Kimbundu|-|kmb_Latn
Northern Kurdish|-|kmr_Latn
Kikongo|-|kon_Latn
Ligurian|-|lij_Latn
Limburgish|-|lim_Latn
Lombard|-|lmo_Latn
Latgalian|-|ltg_Latn
Luba-Kasai|-|lua_Latn
Luo|-|luo_Latn
Mizo|-|lus_Latn
Magahi|-|mag_Deva
Maithili|-|mai_Deva
Minangkabau (Arabic script)|-|min_Arab
Minangkabau (Latin script)|-|min_Latn
Meitei (Bengali script)|-|mni_Beng
Mossi|-|mos_Latn
Maori|-|mri_Latn
Nuer|-|nus_Latn
Nyanja|-|nya_Latn
West Central Oromo|-|gaz_Latn
Pangasinan|-|pag_Latn
Papiamento|-|pap_Latn
Dari|-|prs_Arab
Ayacucho Quechua|-|quy_Latn
Rundi|-|run_Latn
Sango|-|sag_Latn
Sanskrit|-|san_Deva
Santali|-|sat_Olck
Sicilian|-|scn_Latn
Shan|-|shn_Mymr
Samoan|-|smo_Latn
Shona|-|sna_Latn
Southern Sotho|-|sot_Latn
Sardinian|-|srd_Latn
Silesian|-|szl_Latn
Tatar|-|tat_Cyrl
Telugu|-|tel_Telu
Tajik|-|tgk_Cyrl
Tamasheq (Latin script)|-|taq_Latn
Tamasheq (Tifinagh script)|-|taq_Tfng
Tok Pisin|-|tpi_Latn
Tsonga|-|tso_Latn
Turkmen|-|tuk_Latn
Tumbuka|-|tum_Latn
Twi|-|twi_Latn
Central Atlas Tamazight|-|tzm_Tfng
Uyghur|-|uig_Arab
Umbundu|-|umb_Latn
Venetian|-|vec_Latn
Waray|-|war_Latn
"""

# Evaluation-set codes that differ from the script-qualified code.
FLORES_OVERRIDES = {
    "zho_Hans": "cmn_Hans",
    "est_Latn": "ekk_Latn",
    "tgl_Latn": "fil_Latn",
}

# The characters Python's str.strip() removes.
STRIP_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Punctuation counted by the over-punctuation filter.
PUNCTUATION = string.punctuation + "—–"

# Ids of the special symbols, in dictionary order.
SPECIALS = ["<s>", "<pad>", "</s>", "<unk>"]
BOS, PAD, EOS, UNK = 0, 1, 2, 3

# The three specials at the head of a subword vocabulary file.
VOCABULARY_SPECIALS = ["<unk>", "<s>", "</s>"]

WORD_MARK = "▁"
