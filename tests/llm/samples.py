"""Small labelled texts for training in tests; sentences made of parts so that each language has a few hundred."""

import itertools

PARTS = {
    "en": (["Save the", "We could not open the", "Please check the", "You can edit the"], ["report", "invoice", "project", "list of keys"], ["before you leave this page.", "without an internet connection.", "after the next release.", "in the settings at any time."]),
    "de": (["Speichern Sie", "Wir konnten leider nicht öffnen:", "Bitte prüfen Sie", "Sie können jederzeit bearbeiten:"], ["den Bericht", "die Rechnung", "das Projekt", "die Schlüsselliste"], ["bevor Sie diese Seite verlassen.", "ohne Verbindung zum Internet.", "nach der nächsten Version.", "in den Einstellungen."]),
    "fr": (["Enregistrez", "Nous ne pouvons pas ouvrir", "Veuillez vérifier", "Vous pouvez modifier"], ["le rapport", "la facture", "le projet", "la liste des clés"], ["avant de quitter cette page.", "sans connexion internet.", "après la prochaine version.", "dans les paramètres à tout moment."]),
    "es": (["Guarde", "No podemos abrir", "Revise por favor", "Puede editar"], ["el informe", "la factura", "el proyecto", "la lista de claves"], ["antes de salir de esta página.", "sin conexión a internet.", "después de la próxima versión.", "en los ajustes en cualquier momento."]),
    "ja": (["このページを離れる前に", "設定で", "次のリリースの後に", "インターネット接続なしで"], ["レポートを", "請求書を", "プロジェクトを", "キーの一覧を"], ["保存してください。", "確認してください。", "編集できます。", "開くことができません。"]),
}


def lines(lang):
    a, b, c = PARTS[lang]
    sep = "" if lang == "ja" else " "
    return [sep.join(x) for x in itertools.product(a, b, c)]


def documents():
    """(doc_id, lang, text): four sentences each."""
    out, i = [], 0
    for lang in PARTS:
        ls = lines(lang)
        for k in range(0, len(ls), 2):
            i += 1
            out.append((i, lang, (" " if lang != "ja" else "").join(ls[(k + j * 7) % len(ls)] for j in range(4))))
    return out
