"""Fixed values that results depend on: label sets, maps, weights and the prompt."""

DEPARTMENTS = ["儿科", "呼吸内科", "妇科", "心血管内科", "泌尿外科", "消化内科", "皮肤科", "眼科", "神经内科", "精神心理科", "耳鼻喉科", "骨科"]
URGENCIES = ["高", "中", "低"]
LABEL_KEYS = ["department", "urgency", "symptoms"]

# departments renamed and departments whose rows are dropped in cleaning
RENAMED_DEPARTMENTS = {"男科": "泌尿外科", "妇产科": "妇科"}
DROPPED_DEPARTMENTS = ["内分泌科", "内分泌内科", "血液科", "风湿免疫科", "血管外科", "外科", "牙科", "乳腺外科", "内科", "口腔科", "肛肠科"]

# symptom wording to the wording that scores compare
SYMPTOM_WORDING = {
    "发烧": "发热", "高烧": "发热", "低烧": "发热", "头疼": "头痛", "脑袋疼": "头痛", "肚子疼": "腹痛", "肚子痛": "腹痛", "下腹疼痛": "腹痛",
    "下腹痛": "腹痛", "上腹疼痛": "腹痛", "上腹痛": "腹痛", "胃疼": "胃痛", "拉肚子": "腹泻", "便稀": "腹泻", "小便疼": "尿痛", "尿疼": "尿痛",
    "排尿疼痛": "尿痛", "胸口痛": "胸痛", "胸口疼": "胸痛", "喉咙痛": "咽痛", "嗓子疼": "咽痛", "鼻塞流涕": "鼻塞", "流鼻涕": "流涕",
}

# score of a predicted urgency, by "gold>predicted"
URGENCY_SCORE = {"高>高": 1.0, "高>中": 0.2, "高>低": -1.0, "中>高": 0.4, "中>中": 1.0, "中>低": 0.2, "低>高": 0.0, "低>中": 0.5, "低>低": 1.0}

# the department a made-up wrong label takes instead
CONFUSABLE = {
    "神经内科": "骨科", "骨科": "神经内科", "消化内科": "泌尿外科", "泌尿外科": "消化内科", "呼吸内科": "心血管内科", "心血管内科": "呼吸内科",
    "妇科": "泌尿外科", "儿科": "呼吸内科", "眼科": "神经内科", "皮肤科": "泌尿外科", "精神心理科": "神经内科", "耳鼻喉科": "呼吸内科",
}

STRONG_PROMPT = "请根据患者主诉输出严格 JSON，字段为 department、urgency、symptoms，不要输出解释或 Markdown。"

# files of raw labels, the first first in priority
RAW_FILES = ["teacher_batch_1.json", "teacher_batch_2.json", "teacher_recheck.json", "teacher_hotfix.json"]
