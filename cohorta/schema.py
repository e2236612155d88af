"""Names and types of the applicant tables.

Inside the library columns have plain ASCII names; the maps below translate
the names used in files and in applicant records, once, at the edge.
"""

from __future__ import annotations

# Column of the applicant files -> (name here, type).
APPLICANT_COLUMNS = {
    "REGION_DE_NAISSANCE": ("region_naissance", "string"),
    "NIVEAU": ("niveau", "int"),
    "SESSION": ("session", "string"),
    "MENTION": ("mention_l1", "string"),
    "MOYENNE ANNUELLE": ("moyenne_annuelle", "double"),
    "RESULTAT": ("resultat", "string"),
    "RESULTAT APP EVALUATION": ("resultat_app_evaluation", "int"),
    "Année BAC": ("annee_bac", "int"),
    "Sexe": ("sexe", "string"),
    "Série": ("serie", "string"),
    "Ets. de provenance": ("etablissement", "string"),
    "Académie de l'Ets. Prov.": ("academie", "string"),
    "Résidence": ("residence", "string"),
    "Centre d'Ec.": ("centre", "string"),
    "Nbre Fois au BAC": ("nbre_fois_bac", "int"),
    "Mention": ("mention", "string"),
    "Groupe Résultat": ("groupe_resultat", "int"),
    "Année de l'Extrait EC": ("annee_extrait", "int"),
    "Moy. nde": ("moy_nde", "double"),
    "Moy. ère": ("moy_ere", "double"),
    "Moy. S Term.": ("moy_s_term", "double"),
    "Moy. S Term..1": ("moy_s_term_1", "double"),
    "MATH": ("math", "double"),
    "SCPH": ("scph", "double"),
    "FR": ("fr", "double"),
    "PHILO": ("philo", "double"),
    "AN": ("an", "double"),
    "SVT": ("svt", "double"),
    "Tot. Pts au Grp.": ("tot_pts_grp", "int"),
    "Moyenne au Grp.": ("moyenne_grp", "double"),
    "Moy. Gle": ("moy_gle", "double"),
    "Moy. sur Mat.Fond.": ("moy_mat_fond", "double"),
    "Age en Décembre 2018": ("age", "int"),
    "Score DAP": ("score_dap", "double"),
    "Rang DAP": ("rang_dap", "int"),
    "Score L1": ("score_l1", "double"),
    "Rang L1": ("rang_l1", "int"),
}

# Field of an applicant record -> column of the applicant files.
RECORD_FIELDS = {
    "Sexe": "Sexe",
    "Série": "Série",
    "Age_en_Décembre_2018": "Age en Décembre 2018",
    "MATH": "MATH",
    "SCPH": "SCPH",
    "FR": "FR",
    "PHILO": "PHILO",
    "AN": "AN",
    "Moy_nde": "Moy. nde",
    "Moy_ère": "Moy. ère",
    "Moy_S_Term": "Moy. S Term.",
    "Moy_S_Term_1": "Moy. S Term..1",
    "Moy_Gle": "Moy. Gle",
    "Moy_sur_Mat_Fond": "Moy. sur Mat.Fond.",
    "Année_BAC": "Année BAC",
    "Nbre_Fois_au_BAC": "Nbre Fois au BAC",
    "Mention": "Mention",
    "Groupe_Résultat": "Groupe Résultat",
    "Tot_Pts_au_Grp": "Tot. Pts au Grp.",
    "Moyenne_au_Grp": "Moyenne au Grp.",
    "Résidence": "Résidence",
    "Ets_de_provenance": "Ets. de provenance",
    "Centre_Ec": "Centre d'Ec.",
    "Académie_de_Ets_Prov": "Académie de l'Ets. Prov.",
    "REGION_DE_NAISSANCE": "REGION_DE_NAISSANCE",
}

# Inputs of the decision trees, in order.
TREE_FEATURES = (
    "annee_bac", "nbre_fois_bac", "groupe_resultat", "moy_nde", "moy_ere", "moy_s_term",
    "moy_s_term_1", "math", "scph", "fr", "philo", "an", "tot_pts_grp", "moyenne_grp", "moy_gle",
    "moy_mat_fond", "age", "sexe_f", "sexe_m", "serie_s1", "serie_s2", "serie_s3",
    "mention_abien", "mention_bien", "mention_pass", "residence", "etablissement", "centre",
    "academie", "region_naissance", "academie_perf",
)

# One-hot columns of the tree features, by source column.
TREE_FLAGS = {
    "sexe": {"sexe_f": "F", "sexe_m": "M"},
    "serie": {"serie_s1": "S1", "serie_s2": "S2", "serie_s3": "S3"},
    "mention": {"mention_pass": "Passable", "mention_abien": "Assez-Bien", "mention_bien": "Bien"},
}

# Spellings of the applicant files, by the one the tree features know.
MENTION_ALIASES = {"mention": {"Pass": "Passable", "ABien": "Assez-Bien"}}

# One-hot columns of the cohort preparation, by source column.
COHORT_FLAGS = {
    "serie": {"s1": "S1", "s2": "S2", "s3": "S3"},
    "sexe": {"homme": "M", "femme": "F"},
}

# Text columns that become integer codes.
LABEL_COLUMNS = ("residence", "etablissement", "centre", "academie", "region_naissance")

# Outcomes used by the evaluation.
PASSE = "PASSE"
NON_ADMIS = "NON ADMIS"


def record_to_internal() -> dict[str, str]:
    """Record field -> name here."""
    return {field: APPLICANT_COLUMNS[column][0] for field, column in RECORD_FIELDS.items()}


def file_to_internal() -> dict[str, str]:
    """File column -> name here."""
    return {column: name for column, (name, _) in APPLICANT_COLUMNS.items()}
