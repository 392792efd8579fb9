"""The rules as data: what lines are recognised by, and what they then mean.

All of this module is fixed values: words and patterns that must be these for the same
results. Codes of categories, subtypes and labels are our own names.
"""

from __future__ import annotations

# Levels that make a line an issue, and what else may make an INFO line one.
ISSUE_LEVELS = ["warn", "error", "severe", "fatal"]
CRITICAL = ["fatal", "severe", "crash", "outofmemoryerror", "out of memory", "watchdog", "server stopped", "tick took", "can't keep up! is the server overloaded", "崩溃", "内存溢出"]
ERRORS = ["error", "exception", "failed", "failure", "fatal", "severe", "crash", "报错", "异常", "失败"]
WARNINGS = ["warn", "warning", "警告"]
PERFORMANCE = ["can't keep up", "overloaded", "lag", "timeout", "timed out", "tps", "mspt", "卡顿", "延迟", "超时"]
ACTIONABLE = ["could not", "cannot", "timed out", "timeout", "connection reset", "connection refused", "unavailable", "denied", "invalid", "mismatch", "无法", "拒绝", "不可用", "不一致"]
LOAD_FAILURES = ["could not load", "could not enable", "加载失败", "启用失败"]
SENSITIVE = ["threat", "dox", "privacy", "威胁", "开盒", "人肉", "隐私"]
ACCIDENTS = ["奖励发放异常", "活动配置错误", "活动事故", "大范围玩家不满", "玩家不满", "事故"]
METRICS = ["server_metrics", "metrics", "tps", "mspt", "memory", "heap", "gc", "在线人数"]

# Levels and words of lines that may be an error loop.
LOOP_LEVELS = ["WARN", "WARNING", "ERROR", "FATAL", "SEVERE"]
LOOP_WORDS = ["error", "exception", "failed", "failure", "fatal", "severe", "stacktrace", "timeout", "timed out", "unable", "cannot", "can't", "could not", "warn", "warning", "crash", "报错", "异常", "失败", "超时", "警告"]

# Words of each report category.
CATEGORY_WORDS = {
    "complaint": ["can't keep up", "overloaded", "lag", "lagging", "timeout", "timed out", "tps", "mspt", "server is overloaded", "moved too quickly", "moved wrongly", "卡顿", "延迟", "掉线", "超时", "服务器卡"],
    "bug": ["error", "exception", "failed", "failure", "fatal", "severe", "crash", "warn", "warning", "stacktrace", "traceback", "nullpointerexception", "illegalargumentexception", "classnotfoundexception", "nosuchmethoderror", "unsupportedoperationexception", "cannot invoke", "报错", "异常", "失败", "警告", "崩溃"],
    "network": ["connection reset", "connection refused", "connection timed out", "read timed out", "broken pipe", "socket", "netty", "io.netty", "disconnect", "disconnected", "lost connection", "网络", "连接失败", "连接超时", "断开连接"],
    "plugin": ["plugin", "plugins", "enabled plugin", "disabling plugin", "could not load", "could not enable", "depend", "dependency", "softdepend", "插件", "依赖", "加载失败", "启用失败"],
    "economy": ["economy", "vault", "shop", "money", "coin", "balance", "pay", "sell", "buy", "auction", "market", "trade", "商店", "经济", "金币", "余额", "交易", "拍卖"],
    "moderation": ["whitelist", "permission", "permissions", "auth", "login", "logged in", "logged out", "premium", "offline mode", "offline/insecure mode", "online mode", "online-mode", "authenticate usernames", "uuid", "session", "白名单", "权限", "登录", "认证", "正版验证"],
    "cross_server": ["velocity", "bungeecord", "bungee", "proxy", "backend", "server switch", "forwarding", "modern forwarding", "player forwarding", "ip forwarding", "connection request", "转发", "后端", "代理", "跨服"],
}
# Order in which categories are tried; daily is what is left.
PRIORITY = ["community", "chat_review", "player_feedback", "community_ops", "complaint", "network", "plugin", "cross_server", "moderation", "bug", "economy"]

# Words of the categories with rules of their own.
COMMUNITY_STRONG = ["ban", "banned", "kick", "kicked", "mute", "muted", "grief", "cheat", "cheating", "anticheat", "anti-cheat", "xray", "kill aura", "killaura", "vulcan", "封禁", "禁言", "踢出", "作弊", "外挂"]
COMMUNITY_SOFT = ["fly", "speed", "reach", "violation", "vl"]
COMMUNITY_CONTEXT = ["anticheat", "anti-cheat", "vulcan", "flagged", "failed"]
OPERATIONS_WORDS = ["event", "activity", "announcement", "notice", "reward", "vote", "poll", "rank", "season", "competition", "运营", "活动", "公告", "通知", "奖励", "投票", "赛季", "比赛", "招募"]
FEEDBACK_STRONG = ["suggest", "suggestion", "feedback", "feature request", "proposal", "建议", "反馈", "加个", "新增", "优化", "改进"]
FEEDBACK_SOFT = ["idea", "request", "wish", "hope", "想法", "希望", "能不能", "可不可以"]
FEEDBACK_CONTEXT = ["feature", "server", "plugin", "shop", "map", "玩法", "功能", "服务器", "插件", "商店", "地图", "副本", "加", "改", "优化"]
FEEDBACK_ACCESS = ["没权限", "没有权限", "权限不够", "进不去", "过不去"]
IDENTITY_WORDS = ["uuid of player", "permission", "permissions", "auth", "login", "logged in", "logged out", "session", "premium", "whitelist", "没有权限", "权限"]
PLUGIN_TROUBLE = ["could not load", "could not enable", "failed", "failure", "error", "exception", "depend", "dependency", "softdepend", "加载失败", "启用失败", "依赖"]
MILD_TROUBLE = ["失败", "警告", "failed", "failure", "warn", "warning"]
CLEAR_BUGS = ["error", "exception", "stacktrace", "traceback", "nullpointerexception", "illegalargumentexception", "classnotfoundexception", "nosuchmethoderror", "unsupportedoperationexception", "cannot invoke"]
EVENT_FAILURES = ["could not pass event", "eventexception", "playerteleportevent"]

# Words of chat reviews, by class.
REVIEW_LINKS = ["discord.gg", "discord.com/invite", "http://", "https://", "www.", ".com/", ".cn/"]
REVIEW_TRADE = ["代练", "代打", "出售账号", "卖号", "买号", "加群", "加微信", "加qq", "举报聊天"]
REVIEW_ABUSE = ["swear", "profanity", "insult", "abuse", "harassment", "threat", "toxic", "advertising", "辱骂", "骂人", "脏话", "骚扰", "威胁", "刷屏"]
REVIEW_SENSITIVE = ["threat", "威胁", "开盒", "人肉"]

# Rules of operations, first hit wins:
# (subtype, category, severity, words, words that forbid it, words it needs all of, needs an issue level, observation only, report categories).
_POOL = ["added connection", "connection added", "hikaripool - starting", "hikaripool - start completed", "hikaripool - shutdown initiated", "hikaripool - shutdown completed", "hikari pool - starting", "hikari pool - start completed"]
_POOL_MORE = [*_POOL, " - starting", " - start completed", " - shutdown initiated", " - shutdown completed", "no failed migration detected", "repair of failed migration", "idletimeout is close to or more than maxlifetime"]
OPS = [
    ("crash", "lifecycle", "critical", ["watchdog", "server stopped responding", "a single server tick took", "crash report", "crash-reports", "exception in server tick loop", "崩溃"], [], [], False, False, ["bug"]),
    ("memory", "performance", "critical", ["outofmemoryerror", "out of memory", "java heap space", "gc overhead", "内存溢出"], [], [], False, False, ["complaint", "bug"]),
    ("disk_full", "storage", "critical", ["no space left on device", "disk full", "not enough space", "磁盘空间不足", "磁盘满"], [], [], False, False, ["bug"]),
    ("save_failed", "storage", "critical", ["failed to save player data", "could not save player data", "failed to save chunk", "could not save chunk", "failed to write player", "save failed", "保存失败"], [], [], False, False, ["bug", "economy"]),
    ("database_timeout", "storage", "high", ["sqltimeoutexception", "database timeout", "sql timeout", "timed out waiting for connection", "connection is not available", "hikaripool", "hikari pool"], _POOL_MORE, [], False, False, ["bug", "economy"]),
    ("database_connection", "storage", "high", ["communications link failure", "jdbcconnectionexception", "database is locked", "too many connections", "could not connect to database", "failed to connect to database", "mysql", "mariadb", "sqlite", "jdbc"], _POOL_MORE, [], True, False, ["bug", "economy"]),
    ("unauthenticated", "access_security", "high", ["offline/insecure mode", "authenticate usernames", "online-mode"], [], [], True, False, ["moderation"]),
    ("content_definition", "plugin", "medium", ["configuration error in mechanic", "configuration error: particle", "mechanic line:", "must be a valid mythicmob"], [], [], True, False, ["plugin"]),
    ("api_credentials", "plugin", "medium", ["empty api key", "without api key", "missing api key", "api key is missing", "invalid api key"], [], [], True, False, ["plugin"]),
    ("missing_dependency", "plugin", "medium", ["missing dependency", "dependency not found", "required dependency", "worldguard not found"], [], [], True, False, ["plugin"]),
    ("unsafe_mode", "plugin", "medium", ['enabled "unsafe mode"', "this is not supported! use this at your own risk", "websocket server is enabled. this is not recommended for production servers"], [], [], True, False, ["plugin"]),
    ("external_fetch", "plugin", "medium", ["could not fetch skin", "unable to fetch skin", "failed to find image from url", "mineskinrequestexception"], [], [], False, False, ["plugin"]),
    ("update_check", "plugin", "low", ["failed to check for updates", "checkforupdate(", "checkforupdatesandmetrics("], [], [], False, True, ["plugin"]),
    ("compatibility", "plugin", "low", ["cannot interact with paper-plugins", "running on paper", "deprecated mythicmobs api", "legacy placeholder detected", "notify the plugin author to update", "join my discord", "create an issue on github", "already exists. using alternative"], [], [], False, True, ["plugin"]),
    ("load_failed", "plugin", "high", ["could not load plugin", "could not enable", "failed to load plugin", "failed to enable", "error occurred while enabling", "unknown dependency", "missing dependency", "invalid plugin.yml", "加载失败", "启用失败", "依赖缺失"], [], [], False, False, ["plugin", "bug"]),
    ("config_error", "plugin", "medium", ["failed to load config", "could not load config", "invalid configuration", "invalidconfigurationexception", "configuration error", "mapping values are not allowed", "yaml", "toml", "json parse", "jsonsyntaxexception", "jsonparseexception", "malformed json", "jsonreader.syntaxerror", "failed to convert json to nbt", "配置解析", "配置错误"], [], [], True, False, ["plugin", "bug"]),
    ("translation", "plugin", "low", ["no translation for key:", "missing translation", "translation key", "lang file", "locale does not exist"], [], [], False, True, ["plugin"]),
    ("teleport", "position", "high", ["playerteleportevent", "entityteleportevent", "teleportcause", "moved too quickly", "moved wrongly", "fell out of the world", "illegal position", "传送", "虚空", "卡位置"], [], [], True, False, ["complaint", "plugin", "bug"]),
    ("runtime_exception", "plugin", "high", ["could not pass event", "eventexception", "generated an exception", "task", "nullpointerexception", "illegalargumentexception", "nosuchelementexception", "nosuchmethoderror", "classnotfoundexception", "cannot invoke"], [], [], True, False, ["bug"]),
    ("main_thread_lag", "performance", "medium", ["can't keep up", "server is overloaded", "tick took", "mspt", "tps", "overloaded", "卡顿", "延迟"], [], [], False, False, ["complaint"]),
    ("scheduler_delay", "performance", "low", ["session ticker"], [], ["running behind"], False, True, ["complaint"]),
    ("connection", "network", "medium", ["connection reset", "connection refused", "connection timed out", "sockettimeoutexception", "read timed out", "broken pipe", "socketexception", "io.netty", "netty", "连接超时", "连接失败", "断开连接"], [], [], True, False, ["network"]),
    ("forwarding", "network", "high", ["velocity", "bungeecord", "forwarding secret", "player-info-forwarding", "ip forwarding", "backend server", "server switch", "转发", "后端", "跨服"], [], [], True, False, ["cross_server", "network"]),
    ("login", "session", "medium", ["authentication servers are down", "failed to verify username", "profile lookup failed", "login failed", "not authenticated", "whitelist", "session", "认证失败", "登录失败", "白名单"], [], [], True, False, ["moderation", "network"]),
    ("chunk_error", "world", "high", ["failed to load chunk", "could not load chunk", "chunk error", "corrupt chunk", "regionfile", "region file", "world save", "entity ticking", "区块", "世界保存"], [], [], True, False, ["bug", "complaint"]),
    ("shop", "economy", "high", ["vault", "quickshop", "economy", "transaction", "balance", "money", "shop", "auction", "market", "商店", "经济", "金币", "余额"], [], [], True, False, ["economy"]),
    ("duplication", "economy", "critical", ["dupe", "duplication", "duplicate item", "economy exploit", "刷物品", "复制物品", "经济漏洞", "刷钱"], [], [], False, False, ["economy", "community"]),
    ("command", "permission", "medium", ["permission denied", "no permission", "lacks permission", "unknown command", "command exception", "issued server command", "没有权限", "权限不足", "命令异常", "指令异常"], [], [], True, False, ["moderation", "plugin"]),
    ("violation", "anticheat", "medium", ["anticheat", "anti-cheat", "vulcan", "failed fly", "failed speed", "xray", "killaura", "cheat", "hack", "反作弊", "外挂", "飞行", "透视"], [], [], True, False, ["community"]),
    ("backup_failed", "backup", "high", ["backup failed", "restore failed", "rollback failed", "failed to backup", "failed to restore", "备份失败", "恢复失败", "回滚失败"], [], [], False, False, ["bug"]),
]
_WORDS_OF = {r[0]: r[3] for r in OPS}
_PLAIN = lambda subtype: [w for w in _WORDS_OF[subtype] if w.isascii()]

# Words of trouble that let a line of no issue level have a hint.
HINT_WORDS = ["error", "exception", "failed", "failure", "warn", "warning", "timeout", "timed out", "cannot", "could not", "unable", "deprecated", "legacy placeholder detected", "notify the plugin author"]
# Hints, first hit wins: (code, the operations subtype it stands for, severity, words, words that forbid it).
HINTS = [
    ("economy_shop", "shop", "high", ["quickshop", "vault", "rediseconomy", "economy", "transaction", "balance", "shop", "auction", "market"], []),
    ("database_timeout", "database_timeout", "high", _PLAIN("database_timeout"), [*_POOL, "idletimeout is close to or more than maxlifetime"]),
    ("database_connection", "database_connection", "high", [*_PLAIN("database_connection"), "unknown system variable"], [*_POOL, "idletimeout is close to or more than maxlifetime"]),
    ("server_security", "unauthenticated", "high", _PLAIN("unauthenticated"), []),
    ("plugin_content_definition", "content_definition", "medium", _PLAIN("content_definition"), []),
    ("plugin_api_credentials", "api_credentials", "medium", _PLAIN("api_credentials"), []),
    ("plugin_dependency", "missing_dependency", "medium", _PLAIN("missing_dependency"), []),
    ("plugin_unsafe_mode", "unsafe_mode", "medium", _PLAIN("unsafe_mode"), []),
    ("plugin_external_fetch", "external_fetch", "medium", _PLAIN("external_fetch"), []),
    ("plugin_update_check", "update_check", "low", _PLAIN("update_check"), []),
    ("plugin_compatibility", "compatibility", "low", _PLAIN("compatibility"), []),
    ("plugin_config", "config_error", "medium", _PLAIN("config_error"), []),
    ("plugin_translation", "translation", "low", _PLAIN("translation"), []),
    ("plugin_scheduler_delay", "scheduler_delay", "low", _PLAIN("scheduler_delay"), []),
    ("plugin_runtime", "runtime_exception", "high", [w for w in _PLAIN("runtime_exception") if w != "task"], []),
    ("network_connection", "connection", "medium", ["connecttimeoutexception", *_PLAIN("connection")], []),
]
# Report categories of an operations category, where a rule names none.
OPS_REPORTS = {"lifecycle": ["bug"], "performance": ["complaint"], "plugin": ["plugin", "bug"], "session": ["network", "moderation"], "network": ["network", "cross_server"], "world": ["bug", "complaint"], "position": ["complaint", "plugin", "bug"], "storage": ["bug", "economy"], "economy": ["economy"], "permission": ["moderation", "plugin"], "access_security": ["moderation"], "anticheat": ["community"], "backup": ["bug"]}

# Chat labels: (group, label, words), all that fit.
CHAT = [
    ("small_talk", "greeting", ["你好", "早安", "早上好", "晚上好", "晚安", "hello", "hi", "哈喽"]),
    ("small_talk", "joke", ["哈哈", "hhh", "笑死", "绷", "乐", "草"]),
    ("small_talk", "party", ["组队", "一起", "谁来", "带我", "下矿", "打副本", "一起玩"]),
    ("small_talk", "route", ["坐标", "路线", "在哪", "哪里", "怎么去", "新手村", "主城", "/home", "/spawn"]),
    ("small_talk", "beginner_question", ["新手", "萌新", "怎么", "如何", "谁能带", "不会", "教程"]),
    ("small_talk", "rules_question", ["规则", "允许", "可以吗", "能不能", "可不可以"]),
    ("small_talk", "trade_talk", ["交易", "换", "卖", "买", "收购"]),
    ("building", "building_plan", ["建筑", "规划", "设计", "地基", "房子", "扩建"]),
    ("building", "starter_village", ["新手村扩建", "扩建新手村"]),
    ("building", "main_city", ["主城", "城墙", "广场"]),
    ("building", "roads_and_signs", ["道路", "路灯", "灯光", "告示牌", "路牌"]),
    ("building", "public_works", ["公共设施", "公共农场", "公共矿洞", "公共箱子"]),
    ("building", "redstone", ["红石", "机器", "自动机"]),
    ("building", "mob_farm", ["刷怪塔", "刷怪场"]),
    ("admin", "help_request", ["管理员在吗", "管理在吗", "管理员来一下", "管理来一下", "管理员帮", "管理帮", "找管理处理", "找管理员处理", "问管理", "找服主", "服主在吗", "查一下", "处理一下", "帮忙看", "求助", "admin help"]),
    ("admin", "permission_request", ["给权限", "开权限", "申请权限", "权限请求"]),
    ("admin", "complaint", ["投诉", "申诉", "不公平"]),
    ("admin", "report", ["举报", "疑似外挂", "疑似飞行", "疑似透视", "有人开挂", "有人破坏", "有人偷"]),
    ("admin", "appeal", ["解封", "申诉", "误封", "处罚"]),
    ("admin", "evidence", ["视频", "录像", "录屏", "证据", "截图"]),
    ("admin", "item_recovery", ["找回", "补偿", "返还"]),
    ("performance", "lag", ["卡顿", "延迟", "好卡", "很卡", "卡死", "lag", "lagging"]),
    ("performance", "tps", ["tps", "mspt"]),
    ("performance", "dropped", ["掉线", "又掉线", "老掉线", "断开连接", "连接断开", "disconnect"]),
    ("performance", "cannot_join", ["进不去", "进服", "连不上", "连接失败"]),
    ("performance", "cross_server", ["跨服", "切服", "转服", "后端"]),
    ("performance", "teleport", ["传送", "/tp", "tp ", "home 后", "/home 后", "回城失败"]),
    ("performance", "void_or_stuck", ["虚空", "卡位置", "卡住", "卡在原地"]),
    ("performance", "rollback", ["回档", "回滚", "rollback"]),
    ("data", "inventory_sync", ["背包不同步", "背包没同步", "背包不对", "物品不同步"]),
    ("data", "state_sync", ["血量", "状态不同步", "状态没同步", "等级不同步"]),
    ("data", "world_switch", ["切换世界", "换世界", "世界切换"]),
    ("data", "command_broken", ["命令用不了", "指令用不了", "命令异常", "指令异常"]),
    ("data", "no_permission", ["没权限", "没有权限", "权限不够", "权限异常"]),
    ("data", "plugin_broken", ["插件异常", "插件坏", "插件用不了", "功能坏了", "功能异常"]),
    ("data", "chunk_loading", ["区块", "加载不出来", "区块加载"]),
    ("economy", "shop_broken", ["商店异常", "商店坏", "商店用不了", "商店扣", "shop error", "quickshop"]),
    ("economy", "coins_wrong", ["金币异常", "金币没了", "余额不对", "扣了金币", "money bug", "balance bug"]),
    ("economy", "charged_not_received", ["扣钱", "扣款", "扣了", "没到账", "未到账"]),
    ("economy", "items_not_given", ["没给物品", "没有给我物品", "物品未发放", "没发", "未发放"]),
    ("economy", "trade_dispute", ["交易纠纷", "交易没给", "骗交易", "被骗"]),
    ("economy", "public_chest", ["公共箱子", "箱子被动", "公共矿洞"]),
    ("economy", "items_lost", ["物品丢了", "东西没了", "物品丢失"]),
    ("economy", "suspected_theft", ["偷东西", "偷了", "偷窃"]),
    ("economy", "duplication", ["复制物品", "刷物品", "dupe"]),
    ("economy", "economy_exploit", ["经济漏洞", "刷钱", "无限金币"]),
    ("violation", "insult", ["辱骂", "骂人", "脏话", "profanity", "insult"]),
    ("violation", "personal_attack", ["人身攻击", "攻击别人"]),
    ("violation", "provocation", ["引战", "带节奏"]),
    ("violation", "flooding", ["刷屏"]),
    ("violation", "advertising", ["广告", "discord.gg", "加群", "加微信", "加qq"]),
    ("violation", "fraud", ["诈骗", "被骗", "骗钱"]),
    ("violation", "poaching", ["拉人", "拉去别的服"]),
    ("violation", "cheat_report", ["外挂", "开挂", "cheat", "hack"]),
    ("violation", "flight_report", ["飞行", "fly", "飞天"]),
    ("violation", "xray_report", ["透视", "xray", "矿透"]),
    ("violation", "auto_mining", ["自动挖矿", "矿机"]),
    ("violation", "griefing", ["恶意破坏", "破坏建筑", "拆家"]),
    ("violation", "grief_server", ["熊服", "熊孩子"]),
    ("violation", "exploit", ["利用 bug", "利用bug", "漏洞"]),
    ("violation", "permission_abuse", ["权限滥用", "op滥用"]),
    ("violation", "server_threat", ["威胁服务器", "炸服", "打服"]),
]
GROUP_PRIORITY = {"small_talk": 10, "building": 20, "admin": 30, "performance": 50, "data": 55, "economy": 60, "violation": 70}
#: A flight or teleport word alone says little: these must stand beside it.
CHAT_NEEDS = {
    "flight_report": ["举报", "疑似", "怀疑", "开挂", "外挂", "作弊", "违规", "警告", "停止", "别开", "抓到", "处理", "处罚", "封禁", "管理", "report", "cheat", "hack", "ban"],
    "teleport": ["失败", "不能", "无法", "不了", "没反应", "用不了", "卡住", "卡位置", "卡在原地", "虚空", "位置错误", "位置不对", "坐标错误", "坐标不对", "传错", "回不去", "没过去", "不同步", "丢失", "报错", "异常"],
}
CHAT_CRITICAL = ["duplication", "economy_exploit", "griefing", "grief_server", "exploit", "permission_abuse", "server_threat"]
CHAT_HIGH = ["dropped", "teleport", "void_or_stuck", "rollback", "inventory_sync", "state_sync", "world_switch", "shop_broken", "coins_wrong", "charged_not_received", "items_not_given", "items_lost", "suspected_theft", "fraud", "cheat_report", "flight_report", "xray_report", "auto_mining"]
CHAT_SERIOUS = ["admin", "performance", "data", "economy", "violation"]
EVERYONE, EVERYONE_LABELS = ["全服", "所有人", "大规模"], ["dropped", "lag", "cannot_join", "cross_server"]
CHAT_REVIEWED = ["insult", "personal_attack", "provocation", "flooding", "advertising", "fraud", "poaching"]
CHAT_COMMUNITY = ["cheat_report", "flight_report", "xray_report", "auto_mining", "griefing", "grief_server", "exploit", "duplication", "permission_abuse", "server_threat", "suspected_theft"]
#: Labels that put a chat line in a report category.
CHAT_REPORTS = {
    "community": CHAT_COMMUNITY,
    "network": ["dropped", "cannot_join"],
    "cross_server": ["cross_server"],
    "complaint": ["lag", "tps", "teleport", "void_or_stuck", "rollback"],
    "moderation": ["no_permission"],
    "plugin": ["plugin_broken"],
    "bug": ["inventory_sync", "state_sync", "world_switch", "command_broken", "chunk_loading"],
}

# Lines that tell of the machinery only, at INFO and at WARN.
BENIGN_INFO = [
    "environment: environment[sessionhost=", "loaded library ", "loading dependency ", "loaded dependency ", "successfully registered internal expansion", "registered channel:", "got request to register class ", "request_create_item",
    "premium version found", "thanks for your support", "loading server plugin ", "enabling server plugin ", "enabling vulcan", "starting vulcan", "registering vulcan hook", "bstats enabled", "found. enabling hook",
    "registered mythicmobs listener", "registered listener", "fake commands is disable", "has been successfully loaded", "successfully loaded request manager", "storing sessions that were preserved before previous shutdown",
    "session store / pubsub factory used:", "registering integration ", "event action commands into memory", "playtime reward records into memory", "playtime rewards into memory", "loading rewards", "rewards have been loaded",
    "total rewards file successfully loaded", "start completed", "repair of failed migration", "no failed migration detected", "unknown or incomplete command", "paper: using java compression from velocity", "paper: using java cipher from velocity",
    "network season sync enabled", "synchronized customcrops season", "this plugin is running in proxy mode", "you have to put the same config.yml", "|     proxy mode    |", "initializing bungeecord", "proxy server detected in the database",
    "(<proxy>/plugins/", "server permissions file permissions.yml is empty, ignoring it", "registered vault permission & chat hook", "wepif: vault detected! using vault for permissions", "registered permissions provider:",
    "vaultpermissions found. (loaded: true)", "registered extension: permission groups (vault)", "[ok] permission manager test", "selected permission provider:", "log actions is enabled. actions will be logged", "lp user ${player} permission",
    "place the premium jar downloaded", "found 1 duplicates in database. same name, different uuid", "[vault] [permission] superpermissions loaded as backup permission system", "loading internal permission managers", "初始化经济与权限支持", "找到权限插件",
    "no materials whitelisted", "permission plugin: luckperms", "integrated luckperms for offline permission lookups", "enabling anticheatobfuscator", "anticheatobfuscator is enabling", "anticheatobfuscator enabled", "registered fake commands:",
    "issued server command: /redpacket session create", "connecting to redis server ", "认证管理器已初始化", "认证管理器已重载", "通知服务已初始化", "通信组件初始化完成 (代理模式)", "消息转发服务已初始化", "代理模式下不启动ws/rest服务器", "plugin messaging channel已注册",
    "后端服务器已进入代理模式", "代理模式已启用，跳过ws/rest服务器初始化", "已向代理端发送认证请求", "代理端认证成功", "cmi proxy plugin detected", "cmi detected velocity network",
]
BENIGN_INFO_ALL = [["using ", " based io"], ["loaded (", " into memory"], ["keepalive response", "out-of-order"]]
BENIGN_POOL = [" - starting", " - start completed", " - shutdown initiated", " - shutdown completed", "added connection"]
BENIGN_WARN = [
    "****************************", "you are running this server as an administrative or root user", "you are opening yourself up to potential risks when doing this", "madelinemiller.dev/blog/root-minecraft-server",
    "duplicated blocked protocol version", "whilst this makes it possible to use velocity", "docs.papermc.io/velocity/security", "update available", "a new version of ", "no rcon password set in server.properties, rcon disabled",
]
BENIGN_WARN_ALL = [["legacy plugin ", " does not specify an api-version"], ["hikariconfig", "idletimeout is close to or more than maxlifetime"]]

# Routine INFO lines, as patterns whatever their case.
NOISE = [
    r"lost connection:\s*Disconnected\s*$",
    r"logged in with entity id",
    r"UUID of player \S+ is",
    r"\[LP\]\s*LOG\b",
    r"luckperms-worker-\d+/",
    r"\[Server thread/INFO\]:\s*-?\s*[A-Za-z0-9_.+-]+(?:\s*\([^)]+\))?(?:,\s*[A-Za-z0-9_.+-]+(?:\s*\([^)]+\))?){5,}",
    r"^\s*-\s+[A-Za-z0-9_.-]+(?:\s*\([^)]+\))?,",
    r"\bRegistered .+ listener!?$",
    r"\bFake Commands is disable!?$",
    r"\bhas been successfully loaded!?$",
    r"\bSuccessfully loaded request manager\b",
    r"\bStoring sessions that were preserved before previous shutdown\b",
    r"\bSession store / pubsub factory used:",
    r"\bRepair of failed migration\b.*\bNo failed migration detected\b",
    r"\bNo failed migration detected\b",
    r"\bUnknown or incomplete command\b",
    r"认证管理器已(?:初始化|重载)",
    r"通知服务已初始化",
    r"通信组件初始化完成 \(代理模式\)",
    r"消息转发服务已初始化",
    r"代理模式下不启动WS/REST服务器",
    r"Plugin Messaging Channel已注册",
    r"后端服务器已进入代理模式",
    r"代理模式已启用，跳过WS/REST服务器初始化",
    r"已向代理端发送认证请求",
    r"代理端认证成功",
    r"CMI proxy plugin detected",
    r"CMI detected Velocity network",
    r"\bjoined the game\s*$",
    r"\bleft the game\s*$",
]
# Words for which an INFO line is parsed and watched.
INTERESTING = [
    "tps", "mspt", "lag", "overloaded", "can't keep up", "cannot keep up", "running behind", "timeout", "timed out", "disconnect", "disconnected", "lost connection", "moved too quickly", "moved wrongly", "kicked", "banned", "exception", "stacktrace",
    "failed", "failure", "plugin", "chunk", "world", "gc", "garbage collect", "memory", "outofmemory", "out of memory", "deadlock", "watchdog", "stuck", "thread", "save", "saving", "saved", "crash", "restart", "stopped", "started", "reloaded", "reload",
    "error", "warn", "severe", "fatal", "严重", "卡顿", "延迟", "掉线", "断开", "异常", "报错", "失败", "超时", "内存", "插件", "崩服", "卡死",
]
# What an advice must not ask for, as a pattern, and English verbs of the same kind, as whole words.
UNSAFE_ACTION = r"(?i)(?:自动|立即|立刻|马上|直接)(?:封禁|踢(?:出|人)?|回滚|删(?:除|库)|关服|停服)|(?:执行|运行|调用)\s*(?:rcon|/|rm\b|del\b|drop\b|shutdown\b|stop\b)|自动\s*rcon|自动回档"
UNSAFE_VERBS = ["delete", "drop table", "format", "rm -rf", "shut down", "truncate table", "wipe"]
# Domains that an advice names, and words of which the issue must hold one then.
ACTION_DOMAINS = [
    (["数据库", "mariadb", "mysql", "jdbc", "sql", "连接池"], ["数据库", "mariadb", "mysql", "jdbc", "sql", "hikari"]),
    (["经济", "商店", "余额", "扣款", "补偿"], ["经济", "商店", "余额", "扣款", "quickshop", "vault", "物品", "资产"]),
    (["权限", "luckperms", "认证"], ["权限", "luckperms", "认证", "登录", "offline", "代理"]),
    (["网络", "代理", "velocity", "bungee", "防火墙"], ["网络", "代理", "连接", "velocity", "bungee", "timeout", "超时"]),
    (["内存", "heap", "oom", "gc"], ["内存", "heap", "oom", "gc", "memory"]),
    (["磁盘", "disk"], ["磁盘", "disk", "存储", "storage"]),
    (["封禁", "踢出", "禁言", "处罚"], ["封禁", "踢", "禁言", "处罚", "违规", "举报", "外挂", "作弊", "刷屏", "广告", "辱骂"]),
    (["回滚", "回档"], ["回滚", "回档", "资产", "经济", "物品", "数据丢失", "保存失败"]),
]
# Where the names of plugins and players stand in a line (group 1), and names that are none.
PLUGIN_PATTERNS = [
    r"(?i)\[Craft Scheduler Thread[^\]]*? - ([A-Za-z0-9_-]{2,48})/",
    r"\]:\s*\[([A-Za-z0-9_-]{2,64})\]",
    r"(?i)\bplugins[/\\]([^/\\\s]{2,64})[/\\]",
    r"(?i)\b([A-Za-z][A-Za-z0-9_-]{2,48})-(?:HikariPool|Hikari|Pool)\b",
    r"(?i)\[([A-Za-z][A-Za-z0-9_-]{2,32})-(?:worker|thread)(?:-\d+)?/",
]
PLUGIN_SUFFIX = r"(?i)(?:-(?:HikariPool|Hikari|Pool|Connection|Database))+$"
NO_PLUGINS = ["server", "minecraft", "paper", "spigot", "purpur", "folia", "velocity", "bungeecord", "hikari", "hikaripool", "poolbase", "sqlmanager", "warn", "warning", "error", "info"]
NO_PLUGIN = r"(?i)^(?:pool-?\d*$|java|com_|org_|net_)"
PERSON_PATTERNS = [
    r"(?i)(?:^|:\s)([A-Za-z0-9_]{1,16})\s+(?:moved wrongly|moved too quickly)!?",
    r"(?i)\bUUID of player ([A-Za-z0-9_]{1,16}) is\b",
    r"(?i)(?:^|:\s)([A-Za-z0-9_]{1,16})\s+issued server command:",
    r"(?i)(?:^|:\s)([A-Za-z0-9_]{1,16})\s+lost connection:",
    r"(?i)(?:^|:\s)([A-Za-z0-9_]{1,16})\[/[^\]]+\]\s+logged in\b",
]
NO_PERSONS = ["console", "server", "system"]
# How many plugins, files, worlds and positions are listed.
MOST_PLUGINS, MOST_NAMED = 12, 8
# Phrases that address a reader as instructions.
INJECTIONS = [
    r"(?i)忽略(?:以上|前面|先前).{0,20}指令",
    r"(?i)ignore (?:the |all |previous )?(?:above |prior )?instructions?",
    r"(?i)系统(?:提示|指令|消息)",
    r"(?i)system (?:prompt|instruction|message)",
    r"(?i)请(?:立即|马上|现在)?(?:执行|运行|调用).{0,30}",
    r"(?i)<evidence>|</evidence>",
]
