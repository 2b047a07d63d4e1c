"""Column names of the precomputed score tables."""

# Columns taken from the word-count program's output.
LIWC = """
Segment WC Analytic Clout Authentic Tone WPS BigWords Dic Linguistic function. pronoun ppron i we you
shehe they ipron det article number prep auxverb adverb conj negate verb adj quantity Drives
affiliation achieve power Cognition allnone cogproc insight cause discrep tentat certitude differ
memory Affect tone_pos tone_neg emotion emo_pos emo_neg emo_anx emo_anger emo_sad swear Social
socbehav prosocial polite conflict moral comm socrefs family friend female male Culture politic
ethnicity tech Lifestyle leisure home work money relig Physical health illness wellness mental
substances sexual food death need want acquire lack fulfill fatigue reward risk curiosity allure
Perception attention motion space visual auditory feeling time focuspast focuspresent focusfuture
Conversation netspeak assent nonflu filler AllPunc Period Comma QMark Exclam Apostro OtherP
""".split()

# Columns taken from the emotion-vocabulary program's output.
EMOTION_VOCABULARY = """
TTR_Overall TTR_NonDict Neg_CWR Pos_CWR AnxFear_CWR Anger_CWR Sadness_CWR NegUndiff_CWR Neg_CCR
Pos_CCR AnxFear_CCR Anger_CCR Sadness_CCR NegUndiff_CCR Neg_Count Pos_Count AnxFear_Count
Anger_Count Sadness_Count NegUndiff_Count Neg_Unique Pos_Unique AnxFear_Unique Anger_Unique
Sadness_Unique NegUndiff_Unique
""".split()
