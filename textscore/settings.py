"""Defaults that must equal the documented pipeline's for equal results.

Fixed values, stated as they are; every one is also a function argument.
"""

CYCLES = (2013, 2018)
SEATS = ("federal:house", "federal:senate")
AFFILIATES = ("ABC", "CBS", "CW", "FOX", "NBC")
ELECTION = "GENERAL"
COST_QUANTILE = 0.05
SENATE_DISTRICT = "60"
ELECTION_YEAR = "2016"
ELECTION_DAY = "2016-11-08"
CODED = 1
NOT_ISSUES = ("issue", "issue96", "issue97", "issue97_txt", "codingstatus")

MIN_SPEECH_LENGTH = 50
MIN_AD_LENGTH = 10
REMOVE_STOPWORDS = True
LOWERCASE = True

MIN_DF = (2, 5, 10, 100)
MAX_DF = (0.01, 0.05, 0.1, 0.3, 0.5, 0.7, 0.9)
MAX_NGRAM = (1, 2)
ALPHAS = (0.1, 1.0, 10.0, 100.0, 1000.0)
EMBEDDING_ALPHAS = (0.1, 1.0, 10.0, 100.0)
# The smaller grid, which limits the number of terms.
LIMITED_MIN_DF = (2, 5)
LIMITED_MAX_FEATURES = (1000, 5000, 10000)
LIMITED_ALPHAS = (0.1, 1.0, 10.0, 100.0)
FOLDS = 5
MIN_VOCAB = 50
HOLDOUT_SHARE = 0.2
HOLDOUT_SEED = 42

SPEAKER_CORRECTIONS = {
    "NORTON_DC_0": "NORTON_DC_1",
    "PIERLUISI_PR_0": "PIERLUISI_PR_1",
    "CARNEY_DE_0": "CARNEY_DE_1",
    "WELCH_VT_0": "WELCH_VT_1",
    "PLASKETT_VI_0": "PLASKETT_VI_1",
    "CRAMER_ND_0": "CRAMER_ND_1",
    "NOEM_SD_0": "NOEM_SD_1",
    "LUMMIS_WY_0": "LUMMIS_WY_1",
    "ZINKE_MT_0": "ZINKE_MT_1",
    "YOUNG_AK_0": "YOUNG_AK_1",
    "SABLAN_MP_0": "SABLAN_MP_1",
    "BORDALLO_GU_0": "BORDALLO_GU_1",
    "VAN_MD_8": "VANHOLLEN_MD_8",
    "ROS-LEHTINEN_FL_27": "ROS_FL_27",
    "DIAZ-BALART_FL_25": "DIAZ_FL_25",
    "ROYBAL-ALLARD_CA_40": "ROYBAL_CA_40",
    "JACKSON_TX_18": "LEE_TX_18",
}

AD_CORRECTIONS = {
    "LINDBECK_AK_1": "LINDBECK_AK_NA",
    "DAVID_IA_3": "YOUNG_IA_3",
    "ANDY_KY_6": "BARR_KY_6",
    "BEUTLER_WA_3": "HERRERA_WA_3",
    "RODGERS_WA_5": "MCMORRIS_WA_5",
}
