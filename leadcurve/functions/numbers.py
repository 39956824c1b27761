"""Number coercion and rounding."""


def half_up(value: str, digits: int = 0) -> str:
    """Round a double with halves going towards +infinity.

    ``round(-12.25, 1)`` is -12.3 in SQL; here it is -12.2.
    """
    scale = 10**digits
    return f"(floor(cast({value} as double) * {scale}D + 0.5D) / {scale}D)"


def ratio(numerator: str, denominator: str, times: int = 1) -> str:
    """``times * numerator / denominator`` in doubles, null when the denominator is 0 or null."""
    return (
        f"(case when {denominator} != 0 then "
        f"{times}D * cast({numerator} as double) / cast({denominator} as double) end)"
    )


def rounded_ratio(numerator: str, denominator: str, times: int, digits: int) -> str:
    return half_up(ratio(numerator, denominator, times), digits)


def count_or_zero(text: str) -> str:
    """Text to a whole number; the detour over double is taken only by text that is none but has a digit.

    Text without one is 0 anyway, and a cast to double throws and catches an exception for most of it.
    """
    fraction = f"if({text} rlike '[0-9]', nanvl(try_cast({text} as double), 0D), 0D)"
    return f"coalesce(try_cast({text} as bigint), try_cast({fraction} as bigint), 0L)"


def money_or_zero(text: str) -> str:
    """Text to decimal(18,2); text that is no finite number gives 0, an amount that does not fit is an error."""
    amount = f"try_cast({text} as decimal(18,2))"
    finite = f"abs(nanvl(try_cast({text} as double), double('infinity'))) < double('infinity')"
    too_large = f"cast(raise_error(concat('amount does not fit: ', {text})) as decimal(18,2))"
    return f"coalesce({amount}, case when {finite} then {too_large} else cast(0 as decimal(18,2)) end)"


def too_large(text: str, amount: bool = False) -> str:
    """Whether a text is a finite number beyond a long, or beyond decimal(18,2) for an amount. Short plain ones are not tried."""
    kind, limit = ("decimal(18,2)", "1e15D") if amount else ("bigint", "9e18D")
    number = f"abs(try_cast({text} as double))"
    return f"coalesce((length({text}) > 15 or {text} rlike '[eE]') and try_cast({text} as {kind}) is null and {number} >= {limit} and {number} < double('infinity'), false)"


def leading_int(text: str) -> str:
    """Integer made of the leading digits of a text (``'12abc'`` gives 12), else null."""
    return rf"try_cast(nullif(regexp_extract({text}, r'^\s*([+-]?[0-9]+)', 1), '') as int)"


def clamped_leading_int(text: str) -> str:
    """As ``leading_int``, but a number beyond the type is its largest or smallest value, not nothing."""
    digits = rf"regexp_extract({text}, r'^\s*([+-]?[0-9]+)', 1)"
    limit = f"case when {digits} like '-%' then -2147483648 else 2147483647 end"
    return f"(case when {digits} != '' then coalesce(try_cast({digits} as int), {limit}) end)"
