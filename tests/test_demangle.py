from flamelake.functions.demangle import demangle, demangle_rust


def test_paths_and_escapes():
    assert demangle_rust("_ZN5flame5stack4push17h00aa11bb22cc33ddE") == "flame::stack::push"
    assert demangle_rust("_ZN9container25Pair$LT$u8$C$$u20$u16$GT$E") == "container::Pair<u8, u16>"
    assert demangle_rust("_ZN6parser4next17hfedcba9876543210E.llvm.99") == "parser::next"


def test_not_of_this_form():
    for symbol in ("start", "_ZNK5shape4areaEv", "_ZN50shortE", "_ZN4open", "_Z", "", None):
        assert demangle_rust(symbol) is None


def test_given_names_stay_and_the_dictionary_goes_before_the_grammar(spark):
    rows = [
        ("start", "start"),
        ("", "_ZNK5shape4areaEv"),
        ("", "_ZN5flame5stackE"),
        ("kept", "_ZN5flame5stackE"),
        ("", "_Zodd"),
    ]
    functions = spark.createDataFrame(rows, "name string, system_name string")
    names = spark.createDataFrame([("_ZNK5shape4areaEv", "shape::area() const")], "system_name string, name string")
    got = {tuple(r) for r in demangle(functions, names).collect()}
    assert got == {
        ("start", "start"),
        ("shape::area() const", "_ZNK5shape4areaEv"),
        ("flame::stack", "_ZN5flame5stackE"),
        ("kept", "_ZN5flame5stackE"),
        ("_Zodd", "_Zodd"),
    }
    forced = {r["name"] for r in demangle(functions, names, force=True).collect()}
    assert "_ZN5flame5stackE" in forced and "kept" not in forced


def test_newer_names():
    names = {
        "_RNvC6_123foo3bar": "123foo::bar",
        "_RNvNtCs2h_5flame5stack4push": "flame::stack::push",
        "_RNvC5flame4push.llvm.9A": "flame::push",
        "_RNvC5flame4push.cold": "flame::push.cold",
        # Closures and other unnamed members carry their number.
        "_RNCNvC5flame4push0": "flame::push::{closure#0}",
        "_RNCNvC5flame4pushs0_0": "flame::push::{closure#2}",
        "_RNSNvC5flame4push6vtable": "flame::push::{shim:vtable#0}",
        # Generic arguments: types, lifetimes, constants.
        "_RINvC5flame4pushjE": "flame::push::<usize>",
        "_RINvC5flame4pushL_TReQL_hEAlj4_SbE": "flame::push::<'_, (&str, &mut u8), [i32; 4], [bool]>",
        "_RINvC5flame4pushTlEuPhOtE": "flame::push::<(i32,), (), *const u8, *mut u16>",
        "_RINvC5flame4pushKj2a_Kan5_Kb1_Kc41_KpE": "flame::push::<42, -5, true, 'A', _>",
        "_RINvC5flame4pushKo123456789abcdef01_E": "flame::push::<0x123456789abcdef01>",
        "_RINvC5flame4pushKRe6869_E": 'flame::push::<"hi">',
        "_RINvC5flame4pushKRe6869_KANtC1a1bEE": None,
        "_RINvC5flame4pushKAj1_j2_EKTb0_EE": "flame::push::<{[1, 2]}, {(false,)}>",
        "_RINvC5flame4pushKVNtC1m1PS1xj1_1yj2_EE": "flame::push::<{m::P { x: 1, y: 2 }}>",
        # Blocks of methods; the place of the block is not shown.
        "_RNvMC5flameNtC5flame5Stack4push": "<flame::Stack>::push",
        "_RNvMs0_NtC5flame3modNtC5flame5Stack4push": "<flame::Stack>::push",
        "_RNvXC5flameNtC5flame5StackNtC4core5Clone5clone": "<flame::Stack as core::Clone>::clone",
        "_RNvYhNtC4core5Clone5clone": "<u8 as core::Clone>::clone",
        "_RNvMC5flameINtC5flame5StackhE4push": "<flame::Stack<u8>>::push",
        # Functions, traits, bound lifetimes.
        "_RINvC5flame4pushFlEuE": "flame::push::<fn(i32)>",
        "_RINvC5flame4pushFUKCReEbE": 'flame::push::<unsafe extern "C" fn(&str) -> bool>',
        "_RINvC5flame4pushFG_RL0_hEuE": "flame::push::<for<'a> fn(&'a u8)>",
        "_RINvC5flame4pushDNtC1m1TEL_E": "flame::push::<dyn m::T>",
        "_RINvC5flame4pushDINtC1m1FhEp3OutlEL_E": "flame::push::<dyn m::F<u8, Out = i32>>",
        # Back references, Punycode, the crate of an instance.
        "_RINvC5flame4pushNtB2_5StackE": "flame::push::<flame::Stack>",
        "_RNvC5flameu9fltte_1ra": "flame::flätte",
        "_RINvC5flame4pushhEC4main": "flame::push::<u8>",
    }
    names["_RNvC5flameu9fltte_1ra"] = "flame::" + b"fltte-1ra".decode("punycode")
    assert {s: demangle_rust(s) for s in names} == names


def test_not_newer_names():
    odd = [
        "_R", "R", "RSA_sign", "RC4_options", "_RNvC5flame", "_RNvC5flame9push", "_RB_", "_RNvB2_4push", "_RNvC5flame4push!",
        "_RINvC5flame4pushB9_E", "_RINvC5flame4pushL0_E", "_RNvCszzzzzzzzzzzz_1a1b", "_R" + "Nv" * 5000 + "C1a" + "1b" * 5000,
        "_RINvC5flame4pushKcd800_E", "_RINvC5flame4pushKb2_E", "_R1NvC1a1b",
    ]
    assert [s for s in odd if demangle_rust(s) is not None] == []
    # Back references that double the name at each step end at a bound.
    places, text = [], "INvC1a1b"
    for _ in range(40):
        places.append(len(text))
        back = _base62(places[-2]) if len(places) > 1 else None
        text += f"TB{back}B{back}E" if back else "TllE"
    assert demangle_rust("_R" + text + "E") is None


def _base62(place):
    digits = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    place, out = place - 1, ""
    while place or not out:
        place, out = place // 62, digits[place % 62] + out
    return out + "_"
