"""Column builders for principals and access lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

PRINCIPAL = "struct<type:string,name:string>"


def no_names() -> Column:
    return F.array().cast("array<string>")


def lookup(mapping: dict[str, str]) -> Column:
    """A literal map column for a fixed table."""
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def is_blank(name: Column) -> Column:
    return name.isNull() | ~name.rlike(r"(?U)\S")


def or_empty(names: Column) -> Column:
    return F.coalesce(names, no_names())


def principal_list(groups: Column, users: Column, roles: Column) -> Column:
    """Groups, then users, then roles, without blank names."""

    def named(kind: str, names: Column) -> Column:
        kept = F.filter(or_empty(names), lambda n: ~is_blank(n))
        return F.transform(kept, lambda n: F.named_struct(F.lit("type"), F.lit(kind), F.lit("name"), n))

    return F.concat(named("group", groups), named("user", users), named("role", roles))


def principal_count(groups: Column, users: Column, roles: Column) -> Column:
    """Length of ``principal_list`` without building it."""
    names = F.concat(or_empty(groups), or_empty(users), or_empty(roles))
    return F.size(F.filter(names, lambda n: ~is_blank(n)))


def blank_entries(groups: Column, users: Column, roles: Column) -> Column:
    """Labels of blank names: users first, then groups, then roles."""

    def labels(kind: str, names: Column) -> Column:
        return F.transform(
            or_empty(names),
            lambda n, i: F.when(
                is_blank(n), F.concat(F.lit(f"{kind}["), i.cast("string"), F.lit("] is empty"))
            ),
        )

    every = F.concat(labels("users", users), labels("groups", groups), labels("roles", roles))
    return F.array_compact(every)


def access_list(accesses: Column, table: Column, unknown: Column | None = None) -> Column:
    """Allowed accesses as privileges, in order, repeats kept.

    ``table`` maps access words. A word it lacks becomes ``unknown``, or its own upper case where
    that is null.
    """
    kept = F.filter(accesses, lambda a: F.coalesce(a["isAllowed"], F.lit(True)))
    other = F.lit(None).cast("string") if unknown is None else unknown
    return F.coalesce(
        F.transform(kept, lambda a: F.coalesce(table[a["type"]], other, F.upper(a["type"]))), no_names()
    )


def resolved_name(kind: Column, mapped: Column) -> Column:
    """Target name of a principal: users without a domain get the default one."""
    bare_user = (kind == "user") & ~mapped.contains("@")
    return F.when(bare_user, F.concat(mapped, F.lit(rules.USER_DOMAIN))).otherwise(mapped)


def member_test(kind: Column, name: Column) -> Column:
    """SQL text that tests whether the caller is the principal."""
    return F.when(kind == "user", F.concat(F.lit("current_user() = '"), name, F.lit("'"))).otherwise(
        F.concat(F.lit("IS_ACCOUNT_GROUP_MEMBER('"), name, F.lit("')"))
    )


def service_account_kind(user: Column) -> Column:
    """Class of a user name that looks like a Kerberos or service account, else null."""
    service = (
        user.contains("/")
        | user.endswith("_svc")
        | user.endswith("_service_account")
        | user.startswith("svc_")
    )
    return (
        F.when(user.contains("@"), "kerberos_principal")
        .when(user.contains("/"), "kerberos_service")
        .when(service, "service_account")
    )
