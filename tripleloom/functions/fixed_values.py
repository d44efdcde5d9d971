"""Word lists, patterns and formats that results depend on."""

# ---- Fixed values: text functions ----
TRAILING_PUNCTUATION = "，。；、,.!?！？;：:"
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩"
NUMBERING_PATTERNS = [
    r"\d+\.\s",
    r"^\d+\.",
    r"\n\d+\.",
    r"\d+\)",
    r"\d+、",
    r"[①②③④⑤⑥⑦⑧⑨⑩]",
    r"[⑴⑵⑶⑷⑸⑹⑺⑻⑼⑽]",
]
HEADER_RULES = [
    ("contains", "编号名称", "编号名称"),
    ("starts", "编号", "编号"),
    ("contains", "标题", "标题"),
    ("starts", "P11L_M2", "P11L_M2"),
    ("starts_no_baseline", "S12L_M1", "S12L_M1"),
    ("equals", "#", "#"),
    ("contains", "步骤描述", "步骤描述"),
    ("contains", "步骤", "步骤"),
    ("contains", "预期结果", "预期结果"),
    ("contains", "SOP基线", "SOP基线"),
    ("contains", "P基线", "P基线"),
    ("contains", "备注", "备注"),
]
RECORD_SCALARS = ["Test Case Type", "Test Case Name", "Test Case Logic"]
RECORD_LISTS = [
    "Preconditions",
    "Precondition signals",
    "Precondition values",
    "Actions",
    "Action signals",
    "Action values",
    "Expectations",
    "Expectation signals",
    "Expectation values",
]
GROUPED_REQUIRED = ["编号", "编号名称", "标题", "#", "步骤", "预期结果"]
MOJIBAKE_MARKERS = ["鐢", "鍔", "绋", "灏", "闂", "犺", "妗", "℃", "€", "\ufffd", "浠", "棰", "瑙", "鎵"]
USEFUL_WORDS = [
    "电动", "尾门", "功能", "需求", "前提", "触发", "执行", "预期", "状态", "信号",
    "车辆", "解锁", "关闭", "打开", "测试", "章节", "条件", "异常", "诊断",
]
SIGNAL_PREFIX = (
    r"(?U)(SysVol|VehLckngSta|BLEComfortLock EnableSetting|PassiveEntryFunction|DigKeylnCar"
    r"|DoorHandSwiSts|UnlockWindow|KeyInsideCar)\s*[:：]\s*"
)
CASE_MARKERS = ["测试项", "Test item", "测试用例名称", "Test case name", "需求单元ID", "Requirement unit ID"]

# ---- Fixed values: safety records ----
NON_TECHNICAL = [
    "TRANSFERABLE", "SUBSCRIPTION", "PURCHASE", "REFUND", "WARRANTY",
    "PRICE", "PACKAGE", "PROMISED", "SERVICE CENTER", "CUSTOMER SERVICE",
    "APPOINTMENT", "LEASE", "LOAN", "FINANC", "DELIVERY", "DEALER",
    "RESELL", "DEPOSIT", "ORDER FORM", "TRADE IN", "INSURANCE", "RENTAL",
    "LOANER", "SALES ", "MARKETING", "ADVERTIS", "REBATE", "INCENTIVE",
]
FAULT_WORDS = [
    "FAILURE", "MALFUNCTION", "WARNING", "CRASH", "COLLISION",
    "BRAKE", "STEERING", "FIRE", "INJURY", "DISABLED", "UNAVAILABLE",
    "STOPPED", "LOST POWER", "STUCK", "DANGEROUS", "UNSAFE",
    "SUDDEN", "UNEXPECTED", "DEFECTIVE", "FAULTY", "BROKEN",
    "FAILED", "SMOKE", "BURN", "OVERHEAT", "LOCKED", "DEPLOY",
    "NOISE", "VIBRATION", "LEAK", "CRACK", "BENT", "SHUT DOWN",
    "STALL", "ACCELERAT", "DECELERAT", "UNCONTROLL", "LOST CONTROL",
    "WON'T START", "DIED", "BLANK", "BLACK SCREEN",
    "AIRBAG", "SEAT BELT", "SUSPENSION", "WHEEL", "TIRE",
    "DOOR OPEN", "HOOD OPEN", "TRUNK OPEN", "LATCH", "WON'T MOVE",
]
VAGUE_COMPONENTS = ["UNKNOWN OR OTHER", "UNKNOWN", "OTHER", "NOT SURE", "N/A", "", "NONE"]
UNKNOWN_RISK = "unknown_vehicle_risk"
UNCATEGORIZED = "UNCATEGORIZED"
COMPONENT_RULES = [
    ("braking_failure_or_abnormal_braking", ["BRAKE", "SERVICE BRAKES", "PARKING BRAKE", "BRAKING"]),
    ("steering_failure_or_loss_of_control", ["STEERING"]),
    ("airbag_problem", ["AIR BAG", "AIRBAG", "AIR BAGS"]),
    ("electrical_or_battery_failure", [
        "ELECTRICAL SYSTEM", "BATTERY", "HIGH VOLTAGE", "HV BATTERY", "PROPULSION SYSTEM",
        "ELECTRIC POWERTRAIN", "CHARGING"]),
    ("adas_malfunction", [
        "FORWARD COLLISION AVOIDANCE", "AEB", "ADAS", "LANE DEPARTURE", "LANE KEEPING", "AUTONOMOUS",
        "SELF DRIVING", "AUTOPILOT", "ADAPTIVE CRUISE", "BLIND SPOT", "PARKING ASSIST", "TRAFFIC AWARE"]),
    ("vehicle_fire_risk", ["FIRE", "BURN", "SMOKE", "THERMAL", "OVERHEAT"]),
    ("seatbelt_or_restraint_issue", [
        "SEAT BELT", "SEATBELT", "RESTRAINT", "SEAT BELTS", "BUCKLE", "PRETENSIONER", "OCCUPANT PROTECTION"]),
    ("visibility_or_lighting_issue", [
        "VISIBILITY", "WIPER", "WINDSHIELD", "LIGHTING", "DEFROST", "HEADLIGHT", "TAILLIGHT", "TURN SIGNAL",
        "REARVIEW", "GLASS", "WINDSHIELD/WIPER"]),
    ("suspension_or_wheel_issue", [
        "SUSPENSION", "WHEEL", "TIRE", "TYRE", "WHEELS", "TIRES", "HUB", "AXLE", "LINKAGE"]),
    ("software_or_display_failure", [
        "SOFTWARE", "DISPLAY", "INFOTAINMENT", "SCREEN", "FIRMWARE", "CPU", "TOUCHSCREEN",
        "INSTRUMENT CLUSTER", "NAVIGATION"]),
    ("door_lock_or_latch_failure", [
        "LATCH", "LOCK", "DOOR LATCH", "DOOR LOCK", "TRUNK LID", "DOORS", "LATCHES", "LOCKS", "CLOSURE"]),
    ("powertrain_or_drive_unit_failure", [
        "POWER TRAIN", "POWERTRAIN", "DRIVE UNIT", "TRANSMISSION", "ENGINE", "MOTOR", "DRIVELINE", "GEAR"]),
    ("vehicle_stall_or_loss_of_power", [
        "STALL", "LOSS OF POWER", "PROPULSION LOSS", "SHUT DOWN", "SUDDEN POWER LOSS"]),
    ("unexpected_acceleration", [
        "UNINTENDED ACCELERATION", "SUDDEN ACCELERATION", "GHOST ACCELERATION", "UNEXPECTED ACCELERATION"]),
    ("camera_or_sensor_failure", ["CAMERA", "SENSOR", "ULTRASONIC", "RADAR", "LIDAR"]),
    ("body_structure_issue", ["STRUCTURE", "FRAME", "BODY", "CORROSION", "RUST", "PANEL", "ROOF", "TRUNK LID"]),
    ("charging_failure", ["CHARGING", "CHARGE PORT", "CHARGER", "CHARGE CABLE", "ONBOARD CHARGER"]),
]
SUMMARY_RULES = [
    ("braking_failure_or_abnormal_braking", ["BRAKE", "BRAKING"]),
    ("steering_failure_or_loss_of_control", ["STEERING"]),
    ("airbag_problem", ["AIR BAG", "AIRBAG", "AIRBAGS"]),
    ("electrical_or_battery_failure", ["BATTERY", "ELECTRICAL", "HIGH VOLTAGE"]),
    ("adas_malfunction", [
        "AEB", "ADAS", "FORWARD COLLISION", "LANE DEPARTURE", "LANE KEEP", "AUTOPILOT", "SELF DRIVING",
        "FULL SELF", "BLIND SPOT"]),
    ("vehicle_fire_risk", ["FIRE", "BURN", "SMOKE", "FLAME", "THERMAL RUNAWAY", "OVERHEAT"]),
    ("seatbelt_or_restraint_issue", ["SEAT BELT", "SEATBELT", "RESTRAINT", "BUCKLE", "PRETENSIONER"]),
    ("visibility_or_lighting_issue", [
        "VISIBILITY", "WIPER", "WINDSHIELD", "DEFROST", "HEADLIGHT", "TAILLIGHT", "LIGHTING"]),
    ("suspension_or_wheel_issue", ["SUSPENSION", "WHEEL", "TIRE", "TYRE", "CONTROL ARM", "BUSHING"]),
    ("software_or_display_failure", [
        "SOFTWARE", "DISPLAY", "INFOTAINMENT", "SCREEN", "FIRMWARE", "TOUCHSCREEN", "INSTRUMENT PANEL"]),
    ("door_lock_or_latch_failure", ["LATCH", "LOCK", "DOOR", "TRUNK", "HOOD"]),
    ("powertrain_or_drive_unit_failure", [
        "POWER TRAIN", "POWERTRAIN", "DRIVE UNIT", "TRANSMISSION", "ENGINE", "MOTOR", "DRIVELINE", "PROPULSION"]),
    ("vehicle_stall_or_loss_of_power", [
        "STALL", "LOSS OF POWER", "SHUT DOWN", "PROPULSION LOSS", "LOST POWER", "CAR STOPPED"]),
    ("unexpected_acceleration", [
        "UNINTENDED ACCELERATION", "SUDDEN ACCELERATION", "UNEXPECTED ACCELERATION", "SURGED FORWARD",
        "SHOT FORWARD"]),
    ("camera_or_sensor_failure", ["CAMERA", "SENSOR", "ULTRASONIC", "RADAR", "LIDAR"]),
    ("body_structure_issue", ["STRUCTURE", "FRAME", "CORROSION", "RUST", "ROOF", "BODY PANEL"]),
    ("charging_failure", ["CHARGING", "CHARGE PORT", "CHARGER", "ONBOARD CHARGER", "CHARGE CABLE", "PLUG"]),
]
REFINEMENT_RULES = [
    ("STEERING_CONTROL", [
        "STEERING WHEEL", "STEERING STUCK", "STEERING LOCK", "POWER STEERING", "HARD TO STEER", "STEERING RACK",
        "STEERING COLUMN", "ELECTRIC POWER STEERING", "EPS ", "TURN THE WHEEL", "CANNOT STEER", "CAN'T STEER"]),
    ("SERVICE_BRAKES", [
        "BRAKE PEDAL", "BRAKING", "BRAKES FAIL", "BRAKE FAIL", "SERVICE BRAKE", "UNABLE TO STOP", "WON'T STOP",
        "HARD TO STOP", "BRAKE BOOST", "REGENERATIVE BRAK", "ABS ", "ANTI-LOCK", "BRAKE SYSTEM"]),
    ("ADAS", [
        "AUTOPILOT", "FSD ", "FULL SELF DRIVING", "SELF DRIVING", "FORWARD COLLISION", "PHANTOM BRAK", "AEB ",
        "LANE KEEP", "LANE DEPARTURE", "BLIND SPOT", "ADAPTIVE CRUISE", "TRAFFIC AWARE", "AUTO STEER",
        "NAVIGATE ON AUTO", "SUMMON", "AUTO PARK", "COLLISION AVOIDANCE", "AUTOMATIC EMERGENCY"]),
    ("DISPLAY_OR_SOFTWARE", [
        "SCREEN ", "DISPLAY ", "TOUCHSCREEN", "BLACK SCREEN", "BLANK SCREEN", "INFOTAINMENT",
        "INSTRUMENT CLUSTER", "CENTER SCREEN", "TOUCH SCREEN", "SCREEN WENT", "DISPLAY WENT", "REBOOT",
        "FIRMWARE", "SOFTWARE UPDATE", "MCU ", "OVER THE AIR"]),
    ("BATTERY_OR_CHARGING", [
        "BATTERY", "HIGH VOLTAGE", "HV BATTERY", "12V BATTERY", "12 VOLT", "THERMAL RUNAWAY", "BMS ",
        "RANGE SUDDEN", "CHARGE PORT", "CHARGING", "CHARGER", "ONBOARD CHARGER", "SUPERCHARG", "DC FAST",
        "WON'T CHARGE", "CANNOT CHARGE"]),
    ("AIRBAG_OR_RESTRAINT", [
        "AIR BAG", "AIRBAG", "SRS ", "RESTRAINT SYSTEM", "SIDE CURTAIN", "PASSENGER AIR", "DRIVER AIR",
        "FRONTAL AIR", "SEAT BELT PRETENSION"]),
    ("SEAT_BELTS", [
        "SEAT BELT", "SEATBELT", "BUCKLE", "PRETENSIONER", "RETRACTOR", "OCCUPANT PROTECTION", "SEAT BELTS",
        "RESTRAINT"]),
    ("SUSPENSION_OR_WHEEL", [
        "WHEEL ", "WHEELS ", "TIRE ", "TYRE ", "SUSPENSION", "AXLE", "CONTROL ARM", "BUSHING", "LINK ",
        "LOWER ARM", "UPPER ARM", "BALL JOINT", "TIRE ROD", "SHOCK ", "STRUT ", "SPRING", "ALIGNMENT",
        "WOBBL", "SHAKE ", "VIBRAT"]),
    ("POWERTRAIN_OR_ELECTRICAL", [
        "LOST POWER", "SHUT DOWN", "STALLED", "STALL ", "PROPULSION LOSS", "SUDDEN POWER LOSS", "VEHICLE DIED",
        "CAR DIED", "WON'T START", "DRIVE UNIT", "MOTOR ", "POWERTRAIN", "TRANSMISSION", "GEAR", "DRIVELINE",
        "HALF SHAFT", "CV JOINT", "INVERTER", "DC-DC"]),
    ("CAMERA_OR_SENSOR", [
        "CAMERA ", "SENSOR ", "ULTRASONIC", "RADAR ", "LIDAR", "VISIBILITY", "BLIND ", "DETECTION",
        "PARKING SENSOR", "REARVIEW", "SIDE CAMERA", "FRONT CAMERA", "BACKUP CAMERA"]),
    ("DOOR_LOCK_OR_LATCH", [
        "DOOR ", "LATCH", "LOCK ", "TRUNK ", "HOOD ", "HANDLE", "WINDOW ", "POWER WINDOW", "WON'T OPEN",
        "WON'T CLOSE", "STUCK OPEN", "STUCK CLOSE", "AUTO WINDOW"]),
    ("VISIBILITY_OR_LIGHTING", [
        "WINDSHIELD", "WIPER", "DEFROST", "HEADLIGHT", "TAILLIGHT", "FOG LIGHT", "TURN SIGNAL", "HAZARD LIGHT",
        "LIGHTING", "GLASS ", "CRACK ", "CHIP ", "VISIBILITY"]),
    ("UNEXPECTED_ACCELERATION", [
        "ACCELERAT", "SURGED FORWARD", "SHOT FORWARD", "LURCH", "GHOST ACCELERAT", "UNINTENDED ACCEL",
        "SUDDEN ACCEL", "SPEED UP ON ITS OWN", "TOOK OFF"]),
    ("BODY_STRUCTURE", [
        "STRUCTURE", "FRAME", "CORROSION", "RUST", "BODY PANEL", "ROOF ", "PILLAR ", "CHASSIS", "SUBFRAME",
        "WELD", "PAINT ", "PEELING", "BUBBLING"]),
    ("FIRE_OR_THERMAL", [
        "FIRE", "FLAME", "BURN", "SMOKE", "OVERHEAT", "THERMAL", "MELT", "SCORCH", "IGNIT", "COMBUST"]),
    ("SEATS", [
        "SEAT ", "SEATS ", "HEADREST", "ARMREST", "UPHOLSTERY", "CUSHION", "RECLINE", "HEATED SEAT",
        "VENTILATED SEAT"]),
]
RISK_WEIGHTS = {
    "vehicle_fire_risk": 5, "braking_failure_or_abnormal_braking": 4,
    "steering_failure_or_loss_of_control": 4, "airbag_problem": 3,
    "adas_malfunction": 3, "seatbelt_or_restraint_issue": 3,
    "unexpected_acceleration": 3, "electrical_or_battery_failure": 2,
    "software_or_display_failure": 2, "camera_or_sensor_failure": 2,
    "powertrain_or_drive_unit_failure": 2, "vehicle_stall_or_loss_of_power": 2,
    "suspension_or_wheel_issue": 2, "charging_failure": 2,
    "visibility_or_lighting_issue": 1, "door_lock_or_latch_failure": 1,
    "body_structure_issue": 1, "unknown_vehicle_risk": 0,
}
SEVERITY_BANDS = [(5.0, "critical"), (3.0, "high"), (1.5, "medium")]

# ---- Fixed values: document triples ----
RELATION_ALIASES = {"触发condition": "触发条件"}
STRUCTURE_TABLE = "structure_table"
STRUCTURE_RELATIONS = ["输入来自", "输出到", "连接到", "控制对象", "包含子功能"]
SPLIT_RELATIONS = ["前提条件", "触发条件", "抑制条件", "状态保持条件", "复位条件"]
ENUMERATION_PREFIX = r"(?U)^满足以下(?:任意一|任一)?条件[:：]\s*"

# ---- Fixed values: graph ----
CASE_RELATIONS = ["前提条件", "执行动作", "预期行为", "测试用例类型"]
RELATION_ROLES = {
    "preconditions": ["前提条件", "has_precondition"],
    "actions": ["执行动作", "has_action"],
    "expected_behaviors": ["预期行为", "has_expected"],
    "test_type": ["测试用例类型", "belongs_to"],
}
RELATION_RANK = {"前提条件": 0, "执行动作": 1, "预期行为": 2, "测试用例类型": 3}
LABEL_RANK = {"Precondition": 0, "Action": 1, "Expected": 2, "TestType": 3}
TYPE_WEIGHTS = {"TestCase": 1.5, "Precondition": 1.2, "Action": 1.0, "Expected": 0.8, "TestType": 0.5}
NODE_ROLES = {
    "test_case_heads": ["是", "需要前提条件", "预期行为", "前提条件", "操作动作", "预期结果", "前提条件描述", "步骤描述", "P基线", "SOP基线", "备注"],
    "composite_heads": ["执行动作"],
    "precondition_tails": ["需要前提条件", "前提条件"],
    "expectation_tails": ["预期行为", "预期结果"],
    "action_tails": ["执行动作", "操作动作"],
}

# ---- Fixed values: case analytics ----
UNCLASSIFIED = "未分类"
NEGATIVE_WORDS = ["不", "无", "失败", "异常", "错误", "禁止"]
TYPE_QUESTIONS = ["测试类型", "有哪些类型", "类型有哪些"]
CASE_SECTIONS = ["测试项", "前提条件", "执行动作", "预期行为"]
CASE_SECTION_ALIASES = {
    "test item": ["测试项", "测试项目", "Test item", "test item"],
    "preconditions": ["前提条件", "前置条件", "Preconditions", "preconditions"],
    "execution steps": ["执行动作", "操作步骤", "Execution steps", "execution steps"],
    "expected behavior": ["预期行为", "预期结果", "Expected behavior", "expected behavior"],
}

# ---- Fixed values: specification documents ----
SECTION_HEADER = r"^\s*#{1,6}\s*((?:\d+\.)*\d+)\s+(.{1,180})\s*$"
LOW_VALUE_TITLES = "变更历史|需求来源|配置限制|功能框图|性能要求|诊断要求|文档说明"
LOW_VALUE_SECTIONS = LOW_VALUE_TITLES + "|目录"
HIGH_VALUE_SECTIONS = "功能逻辑|常显|TT|Warning|Chime|异常处理|控制|设置|开关|状态|提醒|信号|接口|服务"
USEFUL_SECTIONS = "功能逻辑|常显|TT|Warning|Chime|异常处理|控制|设置|状态|信号|接口|服务|提醒"
FIELD_KEYS = {
    "preconditions": ["前提条件", "前置条件", "适用条件", "配置", "车辆状态", "整车模式"],
    "triggers": ["触发条件", "触发", "输入条件", "请求", "信号变化", "条件"],
    "actions": ["执行动作", "动作", "控制请求", "控制逻辑"],
    "expected_results": ["预期行为", "预期结果", "执行结果", "常显", "文字弹框提示", "报警音", "图标显示", "显示"],
    "hmi_display": ["HMI", "常显", "文字弹框提示", "图标显示", "仪表", "中控屏"],
    "status_feedback": ["状态反馈", "反馈", "响应", "Resp", "Response", "失败提醒", "提醒"],
    "test_environment": ["测试环境", "场景示例", "台架", "实车"],
    "remarks": ["备注", "说明", "项目", "适用项目"],
}
SIGNAL_KEYS = [
    "Signal Name", "信号名称", "信号名", "Service Name", "Interface Name", "Parameter", "发送方", "发送",
    "接收方", "接收", "通信方式", "通讯方式", "信号编码",
]
SIGNAL_NAME_KEYS = ["Signal Name", "信号名称", "信号名", "Service Name", "Interface Name", "Parameter Name"]
SIGNAL_ENCODING_KEYS = ["信号编码", "Parameter", "Parameter name", "Parameter Name"]
FIELD_LABELS = [
    "前提条件", "前置条件", "触发条件", "执行动作", "执行结果", "预期结果", "预期行为", "HMI显示", "文字弹框提示",
    "报警音", "图标显示", "常显", "状态反馈", "测试环境", "场景示例",
]
UNUSABLE_LABELS = ["前提条件", "前置条件", "触发条件", "执行动作", "执行结果", "预期结果", "HMI显示", "文字弹框提示", "报警音", "图标显示", "常显"]
GENERIC_SIGNALS = ["PowerLiftgateSystem", "PowerLiftgate", "PersonalizationData"]
EMPTY_CELLS = ["-", "NA", "N/A", "无"]
VERTICAL_HEADERS = ["HMI界面", "项目", "需求项", "字段"]
FAILURE_WORDS = "失败|异常|Fail|Invalid|not in|未|禁止|不可|拒绝"
BOUNDARY_WORDS = ">=|<=|>|<|边界|超时|timeout|retry|5km/h|10s|3s|6s"
PRIORITY_WORDS = "优先级|仲裁|占用|priority|occupy"
TOPIC_RULES = [
    ("hmi_warning", "HMI warnings and chime/icon alerts", ["TT", "Warning", "Chime", "报警音", "文字弹框", "图标显示", "HMI", "仪表", "中控屏", "常显"]),
    ("remote_control", "Mobile app remote tailgate control", ["APP", "远程", "手机", "静默解锁", "remote"]),
    ("switch_control", "Tailgate button and hard-switch control", ["按键", "硬开关", "外开关", "内开关", "尾门开关", "中控", "开关控制"]),
    ("motion_control", "Tailgate open/close motion control", ["打开", "关闭", "开启", "停止", "运动", "高度", "洗车模式", "防夹"]),
    ("vehicle_state", "Vehicle state and preconditions", ["电源", "车速", "档位", "P档", "整车模式", "低电量", "KL15", "OFF"]),
    ("failure_handling", "Failure reminders and exception handling", ["失败", "异常", "无效", "拒绝", "不满足", "Fail", "Invalid", "DTC"]),
    ("signal_interface", "Signals and service interfaces", ["Signal", "CAN", "LIN", "SOA", "接口", "信号", "报文", "parameter", "PwrLftgt"]),
    ("priority_arbitration", "Service priority and arbitration", ["优先级", "仲裁", "占用", "priority", "occupy"]),
]
META_TITLE = "变更|版本|目录|概述"
KEYWORD_STOP = ["功能", "需求", "条件", "执行", "结果", "所有", "适用", "车辆", "状态", "章节"]

# How much a known word, a mark of wrong decoding and a replacement character weigh in repaired text; codecs tried.
USEFUL_WEIGHT, MOJIBAKE_WEIGHT, LOST_WEIGHT = 8, 12, 20
REPAIR_CODECS = ("gb18030", "gbk")

# Wording of issues found in case texts.
CASE_ISSUES = {
    "missing": "Missing field: ",
    "unnumbered": "Preconditions should use a numbered list (e.g. 1. / 1、)",
    "unparsed": "Could not parse preconditions",
    "actions": "Actions empty or too short",
    "expected": "Expected behavior empty or too short",
    "short": "Content too short; add actionable steps and verifiable expectations",
    "short_fields": "Content is short; add executable steps and verifiable expected behavior.",
}

# Wording of fault triage.
TRIAGE = {
    "preconditions": "Verify preconditions",
    "actions": "Reproduce actions",
    "expected_behaviors": "Compare expected behavior",
    "fallback": "Cross-check on-site signals and logs.",
}

# Wording of answers.
ANSWER = {
    "unnamed": "Unnamed case",
    "not_provided": "Not provided",
    "opening": "Reference answer below.",
    "supported": "**Supported by evidence**:",
    "types": "From retrieved test case evidence, the knowledge graph includes these test types:",
    "cases": "From retrieved evidence, these cases are relevant:",
    "sample": "**Sample case structure**:",
    "case": "- **Case**: ",
    "type": "- **Type**: ",
    "preconditions": "- **Preconditions**: ",
    "actions": "- **Actions**: ",
    "expected": "- **Expected behavior**: ",
    "note": "**Note**: Answer from local case retrieval; open evidence on the right for details.",
    "nothing": "Not enough relevant test case evidence was retrieved from the knowledge graph.\n\n"
    "Try more specific test types, case names, or feature keywords.",
}

# Wording of draft cases.
DRAFT = {
    "missing": "Not specified",
    "unit": "Requirement unit ID: ",
    "section": "Section: ",
    "topic": "Topic: ",
    "no_topic": "Unclustered topic",
    "intents": "Coverage intents: ",
    "name": "Test case name: Verify ",
    "no_name": "STS requirement",
    "preconditions": "Preconditions: ",
    "steps": "Execution steps: ",
    "expected": "Expected behavior: ",
    "signals": "Related signals/interfaces: ",
    "criteria": "Pass/fail criteria: Actual results must match expected behavior; confirm against original STS where fields are not specified.",
}
