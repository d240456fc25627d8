"""Known content types and the byte signatures that announce them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Kind(NamedTuple):
    """One content type: its key here, MIME type, extensions (the first is preferred), category and description."""

    key: str
    mime: str
    extensions: tuple[str, ...]
    category: str
    description: str


class Signature(NamedTuple):
    magic: bytes
    kind: str
    offset: int
    priority: int


# Content types, as key | MIME type | extensions | category | description.
_KINDS = """
PNG | image/png | png | image | PNG image
JPEG | image/jpeg | jpg,jpeg,jpe,jfif | image | JPEG image
GIF | image/gif | gif | image | GIF image
BMP | image/bmp | bmp,dib | image | Windows bitmap
WEBP | image/webp | webp | image | WebP image
TIFF | image/tiff | tif,tiff | image | TIFF image
ICO | image/x-icon | ico | image | Windows icon
CUR | image/x-icon | cur | image | Windows cursor
PSD | image/vnd.adobe.photoshop | psd | image | Adobe Photoshop document
HEIC | image/heic | heic,heif | image | HEIF/HEIC image
AVIF | image/avif | avif | image | AVIF image
JXL | image/jxl | jxl | image | JPEG XL image
JP2 | image/jp2 | jp2,j2k,jpx | image | JPEG 2000 image
SVG | image/svg+xml | svg | image | SVG vector image
CR2 | image/x-canon-cr2 | cr2 | image | Canon RAW image
CR3 | image/x-canon-cr3 | cr3 | image | Canon RAW 3 image
DICOM | application/dicom | dcm,dicom | image | DICOM medical image
PDF | application/pdf | pdf | document | PDF document
RTF | application/rtf | rtf | document | Rich Text Format document
POSTSCRIPT | application/postscript | ps,eps,ai | document | PostScript
OLE2 | application/x-ole-storage | doc,xls,ppt,msg,msi,vsd | document | OLE2 compound document (legacy Office)
DOCX | application/vnd.openxmlformats-officedocument.wordprocessingml.document | docx,docm,dotx,dotm | document | Word document (OOXML)
XLSX | application/vnd.openxmlformats-officedocument.spreadsheetml.sheet | xlsx,xlsm,xltx,xltm | document | Excel workbook (OOXML)
PPTX | application/vnd.openxmlformats-officedocument.presentationml.presentation | pptx,pptm,potx,ppsx | document | PowerPoint presentation (OOXML)
OOXML | application/vnd.openxmlformats-officedocument | docx,xlsx,pptx | document | Office Open XML document
ODT | application/vnd.oasis.opendocument.text | odt | document | OpenDocument text
ODS | application/vnd.oasis.opendocument.spreadsheet | ods | document | OpenDocument spreadsheet
ODP | application/vnd.oasis.opendocument.presentation | odp | document | OpenDocument presentation
ODG | application/vnd.oasis.opendocument.graphics | odg | document | OpenDocument graphics
EPUB | application/epub+zip | epub | document | EPUB e-book
XPS | application/vnd.ms-xpsdocument | xps,oxps | document | XPS document
ZIP | application/zip | zip | archive | ZIP archive
ZIP_EMPTY | application/zip | zip | archive | ZIP archive (empty)
GZIP | application/gzip | gz,gzip,tgz,svgz | archive | gzip compressed data
BZIP2 | application/x-bzip2 | bz2,tbz2 | archive | bzip2 compressed data
XZ | application/x-xz | xz,txz | archive | xz compressed data
ZSTD | application/zstd | zst | archive | Zstandard compressed data
LZ4 | application/x-lz4 | lz4 | archive | LZ4 compressed data
SEVENZ | application/x-7z-compressed | 7z | archive | 7-Zip archive
RAR | application/vnd.rar | rar | archive | RAR archive
TAR | application/x-tar | tar | archive | tar archive
CAB | application/vnd.ms-cab-compressed | cab | archive | Microsoft cabinet archive
ARJ | application/x-arj | arj | archive | ARJ archive
LZIP | application/x-lzip | lz | archive | lzip compressed data
ISO | application/x-iso9660-image | iso | archive | ISO 9660 disc image
JAR | application/java-archive | jar,war,ear | archive | Java archive
APK | application/vnd.android.package-archive | apk | executable | Android package
XPI | application/x-xpinstall | xpi | archive | Browser extension (XPI)
DEB | application/vnd.debian.binary-package | deb | archive | Debian package
RPM | application/x-rpm | rpm | archive | RPM package
PE | application/vnd.microsoft.portable-executable | exe,dll,sys,scr,ocx,com,cpl,drv,efi | executable | Windows PE executable
ELF | application/x-executable | elf,so,o,bin | executable | ELF executable
MACHO | application/x-mach-binary | macho,dylib,bundle | executable | Mach-O executable
JAVA_CLASS | application/x-java-class | class | executable | Java class file
WASM | application/wasm | wasm | executable | WebAssembly binary
DEX | application/x-dex | dex | executable | Dalvik executable
LNK | application/x-ms-shortcut | lnk | executable | Windows shortcut
PYC | application/x-python-code | pyc | executable | Python bytecode
CHM | application/vnd.ms-htmlhelp | chm | executable | Compiled HTML help
MP3 | audio/mpeg | mp3 | audio | MP3 audio
FLAC | audio/flac | flac | audio | FLAC audio
OGG | audio/ogg | ogg,oga,ogv,opus,spx | audio | Ogg container
WAV | audio/wav | wav,wave | audio | WAVE audio
AIFF | audio/aiff | aif,aiff,aifc | audio | AIFF audio
MIDI | audio/midi | mid,midi | audio | MIDI sequence
M4A | audio/mp4 | m4a,m4b,m4p | audio | MPEG-4 audio
AMR | audio/amr | amr | audio | AMR audio
ASF | video/x-ms-asf | asf,wmv,wma | video | Windows Media (ASF)
APE | audio/x-ape | ape | audio | Monkey Audio (APE)
MP4 | video/mp4 | mp4,m4v,mp4v | video | MPEG-4 video
MOV | video/quicktime | mov,qt | video | QuickTime movie
THREEGP | video/3gpp | 3gp,3g2 | video | 3GPP video
AVI | video/x-msvideo | avi | video | AVI video
MKV | video/x-matroska | mkv,mka,mks | video | Matroska video
WEBM | video/webm | webm | video | WebM video
FLV | video/x-flv | flv | video | Flash video
MPEG | video/mpeg | mpg,mpeg,mpe,vob | video | MPEG video
MPEG_TS | video/mp2t | ts,m2ts,mts | video | MPEG transport stream
SWF | application/x-shockwave-flash | swf | executable | Shockwave Flash
TTF | font/ttf | ttf | font | TrueType font
OTF | font/otf | otf | font | OpenType font
WOFF | font/woff | woff | font | WOFF font
WOFF2 | font/woff2 | woff2 | font | WOFF2 font
TTC | font/collection | ttc | font | TrueType collection
EOT | application/vnd.ms-fontobject | eot | font | Embedded OpenType font
SQLITE | application/vnd.sqlite3 | sqlite,sqlite3,db | data | SQLite database
PARQUET | application/vnd.apache.parquet | parquet | data | Apache Parquet
AVRO | application/avro | avro | data | Apache Avro
PCAP | application/vnd.tcpdump.pcap | pcap,cap | data | pcap capture
PCAPNG | application/x-pcapng | pcapng | data | pcapng capture
KEEPASS | application/x-keepass2 | kdbx | data | KeePass database
TORRENT | application/x-bittorrent | torrent | data | BitTorrent metadata
NUMPY | application/x-npy | npy | data | NumPy array
PICKLE | application/x-python-pickle | pkl,pickle | executable | Python pickle (can execute code when loaded)
BLENDER | application/x-blender | blend | data | Blender scene
HDF5 | application/x-hdf5 | h5,hdf5 | data | HDF5 data
GLB | model/gltf-binary | glb | data | glTF binary model
VHD | application/x-vhd | vhd | archive | Virtual hard disk
VMDK | application/x-vmdk | vmdk | archive | VMware disk
WIM | application/x-ms-wim | wim | archive | Windows imaging format
PST | application/vnd.ms-outlook-pst | pst,ost | data | Outlook data file
HTML | text/html | html,htm,xhtml | text | HTML document
XML | application/xml | xml,xsl,xslt,xsd,rdf,wsdl | text | XML document
JSON | application/json | json,geojson,jsonld,map | text | JSON data
PLAIN | text/plain | txt,text,log,md,markdown,csv,tsv,ini,cfg,conf,yaml,yml,toml,rst,srt,vtt | text | Plain text
RSS | application/rss+xml | rss,xml | text | RSS feed
ATOM | application/atom+xml | atom,xml | text | Atom feed
SHELL | text/x-shellscript | sh,bash,zsh,ksh | script | Shell script
SCRIPT | text/x-script | py,pl,rb,php,js,sh | script | Interpreter script (shebang)
PHP | application/x-httpd-php | php,phtml,php3,php4,php5,phps,phar | script | PHP script
PEM | application/x-pem-file | pem,crt,cer,key,pub | data | PEM encoded key/certificate
VCARD | text/vcard | vcf,vcard | text | vCard contact
ICAL | text/calendar | ics,ical,ifb | text | iCalendar
HTA | application/hta | hta | executable | HTML application (executes scripts)
WINDOWS_SCRIPT | text/x-wsf | wsf,wsh | script | Windows Script Host file
EMAIL | message/rfc822 | eml,mht,mhtml | text | Email message / MHTML
REG | text/x-ms-regedit | reg | script | Windows registry file
UTF16_TEXT | text/plain | txt,text,csv,log | text | UTF-16 text
DOC | application/msword | doc,dot,wbk | document | Word 97-2003 document
XLS | application/vnd.ms-excel | xls,xlt,xla | document | Excel 97-2003 workbook
PPT | application/vnd.ms-powerpoint | ppt,pps,pot | document | PowerPoint 97-2003 presentation
MSG | application/vnd.ms-outlook | msg | document | Outlook message
MSI | application/x-msi | msi,msp,mst | executable | Windows Installer package
VSD | application/vnd.visio | vsd,vss,vst | document | Visio 2003 drawing
VSDX | application/vnd.ms-visio.drawing | vsdx,vsdm | document | Visio drawing (OOXML)
RIFF_GENERIC | application/x-riff | riff | data | RIFF container
IFF_GENERIC | application/x-iff | iff | data | IFF container
MACHO_FAT | application/x-mach-binary | macho,dylib | executable | Mach-O universal binary
GZIP_TAR | application/gzip | tgz,gz,tar.gz | archive | gzip compressed tar archive
GZIP_SVG | image/svg+xml | svgz | image | gzip compressed SVG
"""

# Signatures, as bytes in hex, type, offset, priority.
_SIGNATURES = """
89504e470d0a1a0a PNG 0 0
ffd8ff JPEG 0 0
474946383761 GIF 0 0
474946383961 GIF 0 0
424d BMP 0 -5
49492a00 TIFF 0 0
4d4d002a TIFF 0 0
49492a00100000004352 CR2 0 5
00000100 ICO 0 -5
00000200 CUR 0 -5
38425053 PSD 0 0
ff0a JXL 0 -3
0000000c4a584c200d0a870a JXL 0 0
0000000c6a5020200d0a870a JP2 0 0
4449434d DICOM 128 0
255044462d PDF 0 0
7b5c727466 RTF 0 0
25215053 POSTSCRIPT 0 0
c5d0d3c6 POSTSCRIPT 0 0
d0cf11e0a1b11ae1 OLE2 0 0
504b0304 ZIP 0 0
504b0506 ZIP_EMPTY 0 0
504b0708 ZIP 0 0
1f8b GZIP 0 0
425a68 BZIP2 0 0
fd377a585a00 XZ 0 0
28b52ffd ZSTD 0 0
04224d18 LZ4 0 0
377abcaf271c SEVENZ 0 0
526172211a0700 RAR 0 0
526172211a070100 RAR 0 0
7573746172 TAR 257 0
4d534346 CAB 0 0
49536328 CAB 0 0
60ea ARJ 0 -5
4c5a4950 LZIP 0 0
4344303031 ISO 32769 0
213c617263683e0a64656269616e DEB 0 0
edabeedb RPM 0 0
636f6e6563746978 VHD 0 0
4b444d56 VMDK 0 0
4d5357494d000000 WIM 0 0
4d5a PE 0 -5
5a4d PE 0 -6
7f454c46 ELF 0 0
feedface MACHO 0 0
feedfacf MACHO 0 0
cefaedfe MACHO 0 0
cffaedfe MACHO 0 0
cafebabe JAVA_CLASS 0 0
0061736d WASM 0 0
6465780a DEX 0 0
4c00000001140200 LNK 0 0
49545346 CHM 0 0
465753 SWF 0 0
435753 SWF 0 0
5a5753 SWF 0 0
494433 MP3 0 0
fffb MP3 0 -4
fff3 MP3 0 -4
fff2 MP3 0 -4
664c6143 FLAC 0 0
4f676753 OGG 0 0
4d546864 MIDI 0 0
2321414d52 AMR 0 0
3026b2758e66cf11 ASF 0 0
4d414320 APE 0 0
52494646 WAV 0 -1
464f524d AIFF 0 -1
66747970 MP4 4 -1
1a45dfa3 MKV 0 0
464c5601 FLV 0 0
000001ba MPEG 0 0
000001b3 MPEG 0 0
47 MPEG_TS 0 -9
0001000000 TTF 0 -3
74727565 TTF 0 0
4f54544f OTF 0 0
774f4646 WOFF 0 0
774f4632 WOFF2 0 0
74746366 TTC 0 0
4c50 EOT 34 -5
53514c69746520666f726d6174203300 SQLITE 0 0
50415231 PARQUET 0 0
4f626a01 AVRO 0 0
d4c3b2a1 PCAP 0 0
a1b2c3d4 PCAP 0 0
0a0d0d0a PCAPNG 0 0
03d9a29a67fb4bb5 KEEPASS 0 0
64383a616e6e6f756e6365 TORRENT 0 0
934e554d5059 NUMPY 0 0
8002 PICKLE 0 -6
8003 PICKLE 0 -6
800495 PICKLE 0 -6
800595 PICKLE 0 -6
424c454e444552 BLENDER 0 0
894844460d0a1a0a HDF5 0 0
676c5446 GLB 0 0
2142444e PST 0 0
"""

# Other spellings of extensions.
EXTENSION_ALIASES = {
    "jpeg": "jpg",
    "jpe": "jpg",
    "jfif": "jpg",
    "pjpeg": "jpg",
    "tiff": "tif",
    "htm": "html",
    "xhtml": "html",
    "yml": "yaml",
    "mpeg": "mpg",
    "mpe": "mpg",
    "midi": "mid",
    "markdown": "md",
    "text": "txt",
    "gzip": "gz",
    "sqlite3": "sqlite",
    "aiff": "aif",
    "wave": "wav",
    "heif": "heic",
    "tar.gz": "tgz",
}

UNKNOWN = Kind("UNKNOWN", "application/octet-stream", (), "unknown", "Unknown binary data")


def _read_kinds() -> dict[str, Kind]:
    found = {}
    for line in _KINDS.strip().splitlines():
        key, mime, extensions, category, description = line.split(" | ")
        found[key] = Kind(key, mime, tuple(extensions.split(",")), category, description)
    return found


def _read_signatures() -> tuple[Signature, ...]:
    rows = (line.split() for line in _SIGNATURES.strip().splitlines())
    return tuple(Signature(bytes.fromhex(h), k, int(o), int(p)) for h, k, o, p in rows)


KINDS: dict[str, Kind] = _read_kinds()
SIGNATURES = _read_signatures()
#: In the order in which they are tried: high priority, long magic, small offset first; the table's order among equals.
ORDERED = tuple(sorted(SIGNATURES, key=lambda s: (-s.priority, -len(s.magic), s.offset)))
#: Tried last, beyond the head that the others look at.
FAR = Signature(b"CD001", "ISO", 0x8001, 0)
HEAD = 2048


def canonical(extension: str) -> str:
    """The usual spelling of an extension, for values known on the driver."""
    plain = extension.strip().lstrip(".").strip().lower()
    return EXTENSION_ALIASES.get(plain, plain)


def known_kinds() -> list[Kind]:
    """Types that differ in MIME type or extensions, the first of each."""
    first: dict[tuple, Kind] = {}
    for kind in KINDS.values():
        if kind.key == "VSDX":  # told apart within ZIP files only
            continue
        first.setdefault((kind.mime, kind.extensions), kind)
    return list(first.values())


def known_extensions() -> list[str]:
    return sorted({canonical(e) for k in known_kinds() for e in k.extensions})


def kinds_frame(spark: SparkSession) -> DataFrame:
    """kinds(key, mime, extension, canonical, category, description, position): a row per type and extension."""
    rows = [(k.key, k.mime, e, canonical(e), k.category, k.description, i) for i, k in enumerate(known_kinds()) for e in k.extensions]
    return spark.createDataFrame(rows, "key string, mime string, extension string, canonical string, category string, description string, position int")


def signatures_frame(spark: SparkSession) -> DataFrame:
    """signatures(rank, magic, kind, offset, priority) in the order in which they are tried."""
    rows = [(i, bytearray(s.magic), s.kind, s.offset, s.priority) for i, s in enumerate(ORDERED)]
    return spark.createDataFrame(rows, "rank int, magic binary, kind string, offset int, priority int")
