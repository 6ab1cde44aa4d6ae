"""Short help texts."""

TOPICS = {
    "": "Topics: select, list, count, functions, alter, create, drop, grant, revoke, show, timeit, timezones, access.",
    "select": "select <functions> [prefix/suffix] from <series> [where ...] [after|before|between|head|tail ...] [merge as \"name\" [using <functions>]]",
    "list": "list series|shards|groups|tags|pools|users|servers [columns] [series] [where ...] [limit n]",
    "count": "count series [length]|shards [size]|groups|tags|pools|users|servers [where ...]",
    "functions": "count sum mean median median_low median_high min max variance pvariance stddev first last difference derivative timeval interval filter limit offset",
    "alter": "alter series ... tag|untag `t`; alter group|tag|user|database ... set ...",
    "create": "create group `g` for /regex/; create user \"u\" set password \"...\"",
    "drop": "drop group|tag|series|shards|user ...",
    "grant": "grant <access> to user \"u\" [set password \"...\"]",
    "revoke": "revoke <access> from user \"u\"",
    "show": "show [property, ...]",
    "timeit": "timeit <statement>: adds the time it took",
    "timezones": "Names of the IANA time zone database, or NAIVE.",
    "access": "show count list select insert create alter drop grant revoke; profiles read, write, modify, full",
}


def topic(name: str) -> str:
    return TOPICS.get(name, TOPICS.get(name.split("_")[0], TOPICS[""]))
