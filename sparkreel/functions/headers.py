"""Header fields of the supported formats as struct columns over binary data.

Each function reads one header at byte `at` of a binary column. Malformed
headers give ok = false and whatever fields can be read; none raises.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T
from .bits import be, bits, clock33, flag, only_if
from .clock import div
from .sync import first_sync


def _at(at: Column | int) -> Column:
    return F.lit(at) if isinstance(at, int) else at


def flv_file(data: Column) -> Column:
    """Signature, version, audio and video flags, header size."""
    version, flags, offset = be(data, 3, 1), be(data, 4, 1), be(data, 5, 4)
    ok = (F.hex(F.substring(data, 1, 3)) == "464C56") & (version == 1) & (offset == 9)
    return F.struct(version.alias("version"), flag(flags, 4).alias("has_audio"), flag(flags, 1).alias("has_video"), offset.alias("offset"), F.coalesce(ok, F.lit(False)).alias("ok"))


def flv_video(payload: Column) -> Column:
    """Frame type, codec and, for AVC, packet type and signed composition time in ms."""
    head = be(payload, 0, 1)
    codec, frame, raw = bits(head, 8, 4, 4), bits(head, 8, 0, 4), be(payload, 2, 3)
    avc = codec == 7
    composition = F.when(raw >= 1 << 23, raw - (1 << 24)).otherwise(raw)
    return F.struct(
        frame.alias("frame_type"), codec.alias("codec"), T.named(T.FLV_VIDEO, codec).alias("codec_name"),
        F.when(avc, be(payload, 1, 1)).alias("avc_type"), F.when(avc, composition).alias("composition_ms"), F.when(avc, raw).alias("composition_raw"), (frame == 1).alias("key"),
    )


def avc_config(payload: Column) -> Column:
    """Profile, level, unit length size, first parameter sets and both after start codes, of an FLV tag with an AVC configuration; else null.

    Sets are counted and measured where they stand; a cut configuration gives null sets.
    """
    def first(place: Column, count: Column) -> Column:
        size = be(payload, place, 2)
        data = F.substring(payload, place + 3, size.cast("int"))
        return F.when((count > 0) & (F.octet_length(data) == size), data)

    count = be(payload, 10, 1).bitwiseAND(0x1F)
    steps = F.when(count > 0, F.sequence(F.lit(1), count.cast("int"))).otherwise(F.array().cast("array<int>"))
    # Where the sets with their 16-bit lengths end. Steps are taken for more than one only, as a lambda is not compiled.
    many = F.aggregate(steps, F.lit(11), lambda at, _: at + 2 + be(payload, at, 2).cast("int"))
    place = F.when(count == 1, F.lit(13) + be(payload, 11, 2).cast("int")).otherwise(many)
    sps, pps = first(F.lit(11), count), first(place + 1, be(payload, place, 1))
    code = F.unhex(F.lit("000001"))
    fields = F.struct(
        be(payload, 5, 1).alias("version"), be(payload, 6, 1).alias("profile"), be(payload, 8, 1).alias("level"), (be(payload, 9, 1).bitwiseAND(3) + 1).alias("length_size"),
        count.alias("n_sps"), be(payload, place, 1).alias("n_pps"), sps.alias("sps"), pps.alias("pps"), F.concat(code, sps, code, pps).alias("record"),
    )
    return only_if((bits(be(payload, 0, 1), 8, 4, 4) == 7) & (be(payload, 1, 1) == 0), fields)


def flv_size(payload: Column) -> Column:
    """Width and height that a video tag's own header gives: H.263, and VP6 key frames less the cropped part; else null."""
    codec, word = bits(be(payload, 0, 1), 8, 4, 4), be(payload, 4, 6)
    form = bits(word, 48, 6, 3)
    fixed = {2: (352, 288), 3: (176, 144), 4: (128, 96), 5: (320, 240), 6: (160, 120)}
    sizes = [[F.when(form == k, F.lit(v[i])) for k, v in fixed.items()] for i in (0, 1)]
    h263 = [F.coalesce(F.when(form == 0, bits(word, 48, 9 + 8 * i, 8)), F.when(form == 1, bits(word, 48, 9 + 16 * i, 16)), *sizes[i]) for i in (0, 1)]
    crop = be(payload, 1, 1)
    vp6 = vp6_header(payload, F.when(codec == 5, 5).otherwise(2))
    cropped = [vp6["columns"] * 16 - bits(crop, 8, 0, 4), vp6["rows"] * 16 - bits(crop, 8, 4, 4)]
    value = [F.when(codec == 2, h263[i]).when(codec.isin(4, 5), cropped[i]).cast("bigint") for i in (0, 1)]
    return F.struct(value[0].alias("width"), value[1].alias("height"))


def flv_audio(payload: Column) -> Column:
    """Format, nominal and true rate, sample bits, channels; AAC: configuration packet or data."""
    head = be(payload, 0, 1)
    kind, rate = bits(head, 8, 0, 4), bits(head, 8, 4, 2)
    return F.struct(
        kind.alias("format"), T.named(T.FLV_SOUND, kind).alias("format_name"),
        T.at([n for n, _ in T.FLV_RATES.values()], rate).alias("nominal_rate"), T.at([t for _, t in T.FLV_RATES.values()], rate).alias("true_rate"),
        ((bits(head, 8, 6, 1) + 1) * 8).alias("bits"), (bits(head, 8, 7, 1) + 1).alias("channels"), F.when(kind == 10, be(payload, 1, 1)).alias("aac_type"),
    )


def aac_config(data: Column, at: Column | int = 0) -> Column:
    """Object type, sampling rate and channel code of an AAC configuration."""
    word = be(data, at, 2)
    return F.struct(bits(word, 16, 0, 5).alias("object_type"), T.at(T.AAC_RATES, bits(word, 16, 5, 4)).alias("rate"), bits(word, 16, 9, 4).alias("channels"))


def stream_class(code: Column) -> Column:
    """Type and number of a program-stream id."""
    fixed = {0xB8: "all_audio", 0xB9: "all_video", 0xBC: "reserved", 0xBD: "private1", 0xBE: "padding", 0xBF: "private2"}
    audio, video, data = code.bitwiseAND(F.lit(0xE0)) == 0xC0, code.bitwiseAND(F.lit(0xF0)) == 0xE0, code.bitwiseAND(F.lit(0xF0)) == 0xF0
    kind = T.named(fixed, code)
    kind = F.coalesce(kind, F.when(audio, "audio").when(video, "video").when(data, "data"))
    number = F.when(kind == "audio", code.bitwiseAND(F.lit(0x1F))).when(kind.isin("video", "data"), code.bitwiseAND(F.lit(0x0F))).otherwise(0)
    return F.struct(kind.alias("kind"), F.when(kind.isNotNull(), number.cast("bigint")).alias("number"))


def buffer_bound(scale: Column, bound: Column) -> Column:
    return bound * F.when(scale, 1024).otherwise(128)


def pack_header(data: Column, at: Column | int = 0) -> Column:
    """Clock reference, extension, mux rate and stuffing after a pack start code."""
    at = _at(at)
    first = be(data, at + 4, 1)
    two, one = bits(first, 8, 0, 2) == 1, bits(first, 8, 0, 4) == 2
    words = be(data, at + 4, 6)
    scr2 = F.shiftleft(bits(words, 48, 2, 3), 30).bitwiseOR(F.shiftleft(bits(words, 48, 6, 15), 15)).bitwiseOR(bits(words, 48, 22, 15))
    return F.struct(
        one.alias("is_mpeg1"), F.when(two, scr2).when(one, clock33(data, at + 4)).alias("scr"), F.when(two, bits(words, 48, 38, 9)).alias("scr_ext"),
        F.when(two, bits(be(data, at + 10, 3), 24, 0, 22)).when(one, bits(be(data, at + 9, 3), 24, 1, 22)).alias("mux_rate"),
        F.when(two, bits(be(data, at + 13, 1), 8, 5, 3)).when(one, 0).alias("stuffing"), F.coalesce(two | one, F.lit(False)).alias("ok"),
    )


def system_header(data: Column, at: Column | int = 0) -> Column:
    """Bounds, flags and all stream entries after a system header start code."""
    at = _at(at)
    size, words = be(data, at + 4, 2), be(data, at + 6, 6)
    count = F.greatest(div(size - 6, 3), F.lit(0))

    def entry(i: Column) -> Column:
        place = at + 12 + i * 3
        code, word = be(data, place, 1), be(data, place + 1, 2)
        kind = stream_class(code)
        return F.struct(code.alias("id"), kind["kind"].alias("kind"), kind["number"].alias("number"), buffer_bound(bits(word, 16, 2, 1) == 1, bits(word, 16, 3, 13)).alias("bound"))

    entries = F.when(count > 0, F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), entry)).otherwise(F.array().cast("array<struct<id:bigint,kind:string,number:bigint,bound:bigint>>"))
    return F.struct(size.alias("size"), bits(words, 48, 1, 22).alias("rate_bound"), bits(words, 48, 24, 6).alias("audio_bound"), (bits(words, 48, 30, 1) == 1).alias("fixed"), (bits(words, 48, 35, 5)).alias("video_bound"), entries.alias("streams"))


def pes_header(data: Column, at: Column | int = 0) -> Column:
    """Stream, time stamps, start and size of the payload of a version 2 packet; unsupported parts name an error."""
    at = _at(at)
    code, size, one, two, head = be(data, at + 3, 1), be(data, at + 4, 2), be(data, at + 6, 1), be(data, at + 7, 1), be(data, at + 8, 1)
    stamps = bits(two, 8, 0, 2)
    error = F.when(bits(one, 8, 0, 2) != 2, "marker").when(bits(one, 8, 2, 2) != 0, "scrambled").when(stamps == 1, "stamps").when(flag(two, 0x3F), "unsupported field")
    kind = stream_class(code)
    return F.struct(
        code.alias("stream_id"), kind["kind"].alias("kind"), kind["number"].alias("number"), size.alias("size"),
        F.when(stamps >= 2, clock33(data, at + 9)).alias("pts"), F.when(stamps == 3, clock33(data, at + 14)).alias("dts"),
        (F.lit(9) + head).alias("payload_at"), (size - 3 - head).alias("payload_size"), error.alias("error"),
    )


def packet1_header(data: Column, at: Column | int = 0, most_stuffing: int = 16) -> Column:
    """The same for a version 1 packet: stuffing bytes 255, an optional buffer size, then the stamps."""
    at = _at(at)
    tail = F.hex(F.substring(data, at + 7, F.lit(most_stuffing + 1)))
    stuffing = F.call_function("div", F.length(F.regexp_extract(tail, "^(?:FF)*", 0)), F.lit(2)).cast("int")
    place = at + 6 + stuffing
    place = place + F.when(bits(be(data, place, 1), 8, 0, 2) == 1, 2).otherwise(0)
    mark = bits(be(data, place, 1), 8, 0, 4)
    end = place + F.when(mark == 2, 5).when(mark == 3, 10).otherwise(1)
    size = be(data, at + 4, 2)
    error = F.when(stuffing > most_stuffing, "stuffing").when(~mark.isin(2, 3) & (be(data, place, 1) != 0x0F), "marker")
    return F.struct(size.alias("size"), F.when(mark.isin(2, 3), clock33(data, place)).alias("pts"), F.when(mark == 3, clock33(data, place + 5)).alias("dts"), end.cast("bigint").alias("payload_at"), (size + at + 6 - end).alias("payload_size"), error.alias("error"))


def sequence_header(data: Column, at: Column | int = 0) -> Column:
    """Size, aspect and frame-rate codes, bit rate, buffer size after a sequence start code."""
    at = _at(at)
    first, second = be(data, at + 4, 4), be(data, at + 8, 4)
    code = bits(first, 32, 28, 4)
    num, den = ([F.when(code == k, F.lit(v[i])) for k, v in T.FRAME_RATES.items()] for i in (0, 1))
    return F.struct(
        bits(first, 32, 0, 12).alias("width"), bits(first, 32, 12, 12).alias("height"), bits(first, 32, 24, 4).alias("aspect_code"), code.alias("rate_code"),
        F.coalesce(*num).cast("bigint").alias("rate_num"), F.coalesce(*den).cast("bigint").alias("rate_den"),
        (bits(second, 32, 0, 18) * 400).alias("bit_rate"), bits(second, 32, 19, 10).alias("vbv"), (bits(second, 32, 18, 1) == 1).alias("ok"),
    )


def aspect(code: Column, mpeg1: bool = False) -> Column:
    """num and den of an aspect code: of a pixel by version 1, of the display by version 2; null for other codes."""
    ratios = {k: (v, 10000) for k, v in T.PIXEL_HEIGHTS.items()} if mpeg1 else T.ASPECTS
    num, den = (F.coalesce(*[F.when(code == k, F.lit(v[i])) for k, v in ratios.items()]).cast("bigint") for i in (0, 1))
    return F.struct(num.alias("num"), den.alias("den"))


def found_sequence_header(data: Column, mpeg1: bool = False) -> Column:
    """Place, fields and aspect of the first sequence header, which may stand at any byte of data; null without one."""
    at = first_sync(data, "000001B3")
    header = sequence_header(data, at.cast("int"))
    return only_if(at.isNotNull(), F.struct(at.alias("at"), header.alias("header"), aspect(header["aspect_code"], mpeg1).alias("aspect")))


def sequence_extension(data: Column, at: Column | int = 0) -> Column:
    """Profile, progressive flag, chroma format and size extensions."""
    word = be(data, _at(at) + 4, 4)
    return F.struct(bits(word, 32, 0, 4).alias("extension"), bits(word, 32, 4, 8).alias("profile"), (bits(word, 32, 12, 1) == 1).alias("progressive"), bits(word, 32, 13, 2).alias("chroma"), bits(word, 32, 15, 2).alias("width_ext"), bits(word, 32, 17, 2).alias("height_ext"))


def picture_header(data: Column, at: Column | int = 0) -> Column:
    """Temporal reference, coding type, decoder delay, and vector range codes."""
    word = be(data, _at(at) + 4, 5)
    kind = bits(word, 40, 10, 3)
    return F.struct(
        bits(word, 40, 0, 10).alias("temporal_ref"), kind.alias("coding_type"), T.named({1: "I", 2: "P", 3: "B"}, kind).alias("ptype"), bits(word, 40, 13, 16).alias("delay"),
        F.when(kind.isin(2, 3), bits(word, 40, 29, 1)).alias("full_pel_forward"), F.when(kind.isin(2, 3), bits(word, 40, 30, 3)).alias("forward_code"),
        F.when(kind == 3, bits(word, 40, 33, 1)).alias("full_pel_backward"), F.when(kind == 3, bits(word, 40, 34, 3)).alias("backward_code"),
    )


def picture_extension(data: Column, at: Column | int = 0) -> Column:
    """Vector range codes, precision, structure and flags of a picture coding extension."""
    word = be(data, _at(at) + 4, 5)
    codes = [bits(word, 40, 4 + 4 * i, 4).alias(n) for i, n in enumerate(("f00", "f01", "f10", "f11"))]
    names = ("top_first", "frame_pred_dct", "concealment", "q_scale", "intra_vlc", "alternate_scan", "repeat_first")
    return F.struct(*codes, bits(word, 40, 20, 2).alias("dc_precision"), bits(word, 40, 22, 2).alias("structure"), *[(bits(word, 40, 24 + i, 1) == 1).alias(n) for i, n in enumerate(names)])


def gop_header(data: Column, at: Column | int = 0) -> Column:
    """Time code, closed and broken flags."""
    word = be(data, _at(at) + 4, 4)
    return F.struct((bits(word, 32, 0, 1) == 1).alias("drop"), bits(word, 32, 1, 5).alias("hours"), bits(word, 32, 6, 6).alias("minutes"), bits(word, 32, 13, 6).alias("seconds"), bits(word, 32, 19, 6).alias("pictures"), (bits(word, 32, 25, 1) == 1).alias("closed"), (bits(word, 32, 26, 1) == 1).alias("broken"))


def mpa_header(data: Column, at: Column | int = 0) -> Column:
    """MPEG audio frame header: version, layer, rates, channels, frame length in bytes, ok."""
    word = be(data, at, 4)
    version_code, layer_code, index, rate_code = bits(word, 32, 11, 2), bits(word, 32, 13, 2), bits(word, 32, 16, 4), bits(word, 32, 20, 2)
    padding, mode = bits(word, 32, 22, 1), bits(word, 32, 24, 2)
    low, layer = (version_code != 3).cast("int"), 4 - layer_code
    shift = F.when(version_code == 3, 1).when(version_code == 2, 2).otherwise(4)
    kbps, rate = T.mpa_kbps(low + 1, layer, index), div(T.at(T.SAMPLE_RATES, rate_code), shift)
    ok = (bits(word, 32, 0, 11) == 0x7FF) & (layer_code != 0) & (index != 15) & (rate_code != 3)
    length = F.when(layer == 1, (div(kbps * 12000, rate) + padding) * 4).when(layer == 2, div(kbps * 144000, rate) + padding).otherwise(div(kbps * 144000, rate * (low + 1)) + padding)
    values = {"layer": layer, "kbps": kbps, "rate": rate, "channels": F.when(mode == 3, 1).otherwise(2), "frame_len": F.when(index != 0, length)}
    good = F.coalesce(ok, F.lit(False))
    return F.struct(*[F.when(good, c.cast("bigint")).alias(n) for n, c in values.items()], good.alias("ok"))


def ac3_header(data: Column, at: Column | int = 0) -> Column:
    """AC-3 sync information: rates, channels, low-frequency flag, frame length in bytes, ok."""
    at = _at(at)
    codes, bsid, mode_byte = be(data, at + 4, 1), bits(be(data, at + 5, 1), 8, 0, 5), be(data, at + 6, 1)
    size_code, rate_code, mode = bits(codes, 8, 2, 6), bits(codes, 8, 0, 2), bits(mode_byte, 8, 0, 3)
    kbps = T.at(T.AC3_RATES, F.shiftright(size_code, 1))
    half = F.when(bsid == 9, 2).when(bsid == 10, 4).when(bsid == 11, 8).otherwise(1)
    length = F.when(rate_code == 0, kbps * 4).when(rate_code == 1, (div(kbps * 320, 147) + size_code % 2) * 2).when(rate_code == 2, kbps * 6)
    # The low-frequency bit follows the mix levels that the channel mode has.
    lfe_bit = F.when(mode == 0, 0x10).when(mode == 1, 0x10).when(mode.isin(2, 3, 4, 6), 0x04).otherwise(0x01)
    ok = F.coalesce((be(data, at, 2) == 0x0B77) & (bsid < 12) & (size_code < 38) & (rate_code < 3), F.lit(False))
    fields = {"rate": div(T.at(T.AC3_SAMPLE_RATES, rate_code), half), "bit_rate": div(kbps * 1000, half), "channels": T.at(T.AC3_CHANNELS, mode), "lfe": (mode_byte.bitwiseAND(lfe_bit.cast("bigint")) != 0).cast("bigint"), "frame_len": length}
    return F.struct(*[F.when(ok, c.cast("bigint")).alias(n) for n, c in fields.items()], ok.alias("ok"))


def vp6_header(data: Column, at: Column | int = 0) -> Column:
    """Key flag, quantizer and, in key frames, the size in macroblocks."""
    at = _at(at)
    head = be(data, at, 1)
    key = bits(head, 8, 0, 1) == 0
    place = at + 2 + F.when(bits(head, 8, 7, 1) == 1, 2).otherwise(0)
    return F.struct(key.alias("key"), bits(head, 8, 1, 6).alias("quantizer"), (bits(head, 8, 7, 1) == 1).alias("separated"), F.when(key, be(data, place, 1)).alias("rows"), F.when(key, be(data, place + 1, 1)).alias("columns"))


def riff(data: Column) -> Column:
    """Format, channels, rate, byte rate, block size, bits of a canonical WAV header; null fields if it is none."""
    text = F.hex(F.substring(data, 1, 16))
    ok = F.coalesce(text.startswith("52494646") & text.endswith("57415645666D7420"), F.lit(False))

    def le(at: int, n: int) -> Column:
        return F.when(ok, be(F.concat(*[F.substring(data, at + n - i, 1) for i in range(n)]), 0, n))

    return F.struct(le(20, 2).alias("format"), le(22, 2).alias("channels"), le(24, 4).alias("rate"), le(28, 4).alias("byte_rate"), le(32, 2).alias("block_align"), le(34, 2).alias("bits"), ok.alias("ok"))


def same_wave(a: Column, b: Column) -> Column:
    """Whether two WAV headers agree in format, channels, rate and bits."""
    fields = ("format", "channels", "rate", "bits")
    same = a["ok"] & b["ok"]
    for f in fields:
        same = same & (a[f] == b[f])
    return F.coalesce(same, F.lit(False))


def pcm_ok(channels: Column, width: Column, rate: Column, block_align: Column, byte_rate: Column) -> Column:
    """Consistency of a PCM type: one or two channels of 8 or 16 bits, sizes that follow, no 32-bit overflow."""
    ok = channels.isin(1, 2) & width.isin(8, 16) & (block_align == div(channels * width, 8)) & (byte_rate == rate * block_align) & (rate * block_align < 1 << 32)
    return F.coalesce(ok, F.lit(False))


def guessed_aspect(width: Column, height: Column, code: Column) -> Column:
    """Pixel aspect num:den in lowest terms from a display aspect code."""
    pairs = [F.when(code == k, F.struct((F.lit(n).cast("bigint") * height).alias("n"), (F.lit(d).cast("bigint") * width).alias("d"))) for k, (n, d) in T.ASPECTS.items() if k > 1]
    square = F.when(code == 1, F.struct(F.lit(1).cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("d")))
    return F.coalesce(square, *pairs)
